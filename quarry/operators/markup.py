"""Pages as trees of elements: anchors with the row they stand in, and detail pages."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Elements without content, elements whose content is no markup, and elements that stand on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
LINES = frozenset("address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul".split())
#: A start tag ends the nearest open element of these names, unless one of SCOPE was opened since.
ENDS = {"li": ("li",), "p": ("p",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "a": ("a",)}
SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
#: What an anchor's row may be, nearest first.
ROW = ("tr", "li", "article", "section", "div")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_HEADING = re.compile("h[1-6]")
#: File name of a standard, a fixed value: code, version, category.
STANDARD = r"^(\d+(?:[-.]\d+)*)_V([\d.]+)_([A-Z_]+)_(.+?)\.pdf$"

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class _Tree:
    """The elements of one page, in document order, from a stack of open ones.

    An end tag ends the nearest open element of its name and all opened in it, or nothing
    if there is none.  ``near`` names groups of tags: an element knows its nearest open
    ancestor in each.  ``references``: those that texts decode; None: all, as HTML does.
    """

    def __init__(self, page: str, near: dict[str, tuple[str, ...]], references: dict[str, str] | None = None):
        self.near, self.references, self.elements = near, references, []
        self.pieces, self.ink = [], [0]  # texts, and the signs that are no white space before each
        self.open: list[int] = []  # numbers of open elements
        self.named: dict[str, list[int]] = {}  # name -> places in the stack
        self.scopes: list[int] = []  # places of SCOPE elements
        self.base, self.heading = "", None
        at = 0
        for m in _TAG.finditer(page):
            if m.start() < at:
                continue  # inside a script or style
            self._text(page[at : m.start()])
            at = m.end()
            if m[1]:
                self._end(m[1].lower())
            elif m[2]:
                name = m[2].lower()
                self._start(name, m[3])
                if name in RAW:
                    raw = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I)
                    at = raw.search(page, at).start()
        self._text(page[at:])
        while self.open:
            self._pop()

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append(self._decoded(text))
            self.ink.append(self.ink[-1] + sum(map(len, self.pieces[-1].split())))

    def _decoded(self, text: str) -> str:
        if self.references is None:
            return html.unescape(text)
        for name, sign in self.references.items():
            text = text.replace(name, sign)
        return text

    def _line(self) -> None:
        if self.pieces and self.pieces[-1] != " ":
            self.pieces.append(" ")
            self.ink.append(self.ink[-1])

    def _pop(self) -> None:
        element = self.elements[self.open.pop()]
        self.named[element["tag"]].pop()
        if element["tag"] in SCOPE:
            self.scopes.pop()
        element["after"] = len(self.pieces)
        if element["tag"] in LINES:
            self._line()

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _end(self, name: str) -> None:
        if places := self.named.get(name):
            self._close(places[-1])

    def _start(self, name: str, attributes: str) -> None:
        places = [self.named[x][-1] for x in ENDS.get(name, ()) if self.named.get(x)]
        if places and max(places) >= (self.scopes[-1] if self.scopes else 0):
            self._close(max(places))
        if name in LINES:
            self._line()
        held = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(attributes))}  # the first of a name counts
        parent = self.open[-1] if self.open else None
        above = self.elements[parent] if parent is not None else {"tag": "", "near": dict.fromkeys(self.near)}
        near = {g: parent if above["tag"] in tags else above["near"][g] for g, tags in self.near.items()}
        n = len(self.elements)
        self.elements.append({"n": n, "tag": name, "parent": parent, "depth": len(self.open), "heading": self.heading, "attributes": held, "near": near, "first": len(self.pieces), "after": len(self.pieces)})
        if _HEADING.fullmatch(name):
            self.heading = n
        if name == "base" and not self.base:
            self.base = held.get("href", "")
        if name not in VOID:
            self.open.append(n)
            self.named.setdefault(name, []).append(len(self.open) - 1)
            if name in SCOPE:
                self.scopes.append(len(self.open) - 1)

    def text(self, element: dict, longest: int) -> str:
        """The element's text with white space folded, up to ``longest`` signs; no more of it is read."""
        first = element["first"]
        enough = bisect.bisect_right(self.ink, self.ink[first] + longest, first, element["after"] + 1)
        return " ".join("".join(self.pieces[first : min(enough, element["after"])]).split())[:longest]


def elements(pages: DataFrame, id: str, page: str, address: str, *, tags: tuple[str, ...] | None = None, near: dict[str, tuple[str, ...]] | None = None, longest: int = 180, references: dict[str, str] | None = None) -> DataFrame:
    """(id, n, tag, parent, depth, heading, attributes, near, address, text) of each element, or of those of ``tags``, in document order.

    ``near`` names groups of tags; near[name] is the number of the nearest open ancestor of
    the group; ``heading`` is that of the last h1 to h6 begun before.  ``address`` is the element's href against the page's base (its own address
    or its first <base>); text is folded and cut to ``longest`` signs; it decodes ``references``
    in turn, or all that HTML knows if None.  A map: each page is
    read on its own, in time that grows with its length, and no element lists its ancestors.

    Comments, scripts and styles hold no elements and no text; tags that are not closed end
    with their parent; end tags without a start count for nothing; null and empty pages have
    no elements; an href that is no address stays as it is.
    """
    groups = near or {}

    def resolved(base: str, href: str | None) -> str | None:
        if href is None:
            return None
        try:
            return urljoin(base, href.strip())
        except ValueError:
            return href

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, own in zip(batch["id"], batch["page"], batch["address"], strict=True):
                tree = _Tree(text or "", groups, references)
                base = resolved(own or "", tree.base) or ""
                chosen = [x for x in tree.elements if tags is None or x["tag"] in tags]
                for at in range(0, len(chosen), 10_000):
                    yield pd.DataFrame(
                        [(key, x["n"], x["tag"], x["parent"], x["depth"], x["heading"], x["attributes"], x["near"], resolved(base, x["attributes"].get("href")), tree.text(x, longest)) for x in chosen[at : at + 10_000]],
                        columns=["id", "n", "tag", "parent", "depth", "heading", "attributes", "near", "address", "text"],
                    ).astype({"parent": "Int64", "heading": "Int64"})

    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(page).alias("page"), F.col(address).alias("address"))
    schema = "id long, n int, tag string, parent int, depth int, heading int, attributes map<string,string>, near map<string,int>, address string, text string"
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id)


def anchors(pages: DataFrame, id: str, page: str, address: str, pattern: str | None = None) -> DataFrame:
    """(id, n, href, text, row, section) of each anchor with an href (S25): its address, its text (160 signs), the text of the nearest
    table row, list item, article, section or division around it (180 signs, empty if none), and the text of the last heading before it.

    ``pattern`` keeps anchors whose address matches it.  Rows meet anchors by page and number.
    """
    heads = tuple(f"h{k}" for k in range(1, 7))
    tree = elements(pages, id, page, address, tags=("a", *ROW, *heads), near={"row": ROW})
    found = tree.where("tag = 'a' AND address IS NOT NULL").withColumn("around", F.col("near")["row"])
    if pattern is not None:
        found = found.where(F.col("address").rlike(pattern))
    named = lambda tags, c: tree.where(F.col("tag").isin(*tags)).select(F.col(id).alias(f"_{c}_id"), F.col("n").alias(f"_{c}_n"), F.col("text").alias(c))
    for tags, at, c in ((ROW, "around", "row"), (heads, "heading", "section")):
        found = found.join(named(tags, c), (F.col(id) == F.col(f"_{c}_id")) & (F.col(at) == F.col(f"_{c}_n")), "left")
    return found.select(id, "n", F.col("address").alias("href"), F.substring("text", 1, 160).alias("text"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("row", "section")))


def _first(condition: Column, value: Column) -> Column:
    """Of the rows of a page that meet the condition, the value of the first."""
    return F.min_by(F.when(condition, value), F.when(condition, F.col("n")))


def details(pages: DataFrame, id: str, page: str, address: str, references: dict[str, str] | None = None) -> DataFrame:
    """(id, title, released, pdf_url, code, version, category, categories) of each page (S27): one row a page.

    The first heading and the first time of the article (its datetime, else its text), the first link to a
    standards file, parsed by its name, and the texts of the article's links to methodologies, in order.
    Texts decode ``references``, or all character references if None.
    """
    tree = elements(pages, id, page, address, near={"article": ("article",)}, longest=300, references=references)
    inside = F.col("near")["article"].isNotNull()
    href = F.coalesce(F.col("attributes")["href"], F.lit(""))
    moment = F.col("attributes")["datetime"]
    pdf = (F.col("tag") == "a") & href.contains("/standards/") & href.endswith(".pdf")
    listed = (F.col("tag") == "a") & inside & href.contains("/documents/methodology/")
    timed = inside & ((F.col("tag") == "time") | moment.isNotNull())
    name = F.regexp_replace("text", r"[,\s]+$", "")
    wanted = tree.where(((F.col("tag") == "h1") & inside) | timed | pdf | listed)
    found = wanted.groupBy(id).agg(
        _first((F.col("tag") == "h1") & inside, F.col("text")).alias("title"),
        _first(timed, F.coalesce(F.nullif(F.trim(moment), F.lit("")), F.col("text"))).alias("released"),
        _first(pdf, href).alias("pdf_url"),
        F.transform(F.sort_array(F.collect_list(F.when(listed, F.struct("n", name.alias("text"))))), lambda x: x["text"]).alias("categories"),
    )
    part = lambda k: F.regexp_extract(F.element_at(F.split("pdf_url", "/"), -1), STANDARD, k)
    out = pages.select(id).join(found, id, "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        id, *(empty(F.col(c)).alias(c) for c in ("title", "released", "pdf_url")), empty(F.translate(part(1), ".", "-")).alias("code"), empty(part(2)).alias("version"),
        empty(part(3)).alias("category"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )
