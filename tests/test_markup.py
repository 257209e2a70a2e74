"""The page tree against a tree built on the standard library's parser, on given pages and on broken ones."""

import html.parser
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quarry.operators import markup

NEAR = {"row": markup.ROW, "article": ("article",)}


class Plain(html.parser.HTMLParser):
    """(tag, parent, near row, near article, attributes) of each element, by the stated rules, with whole stacks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack = [], []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag, attrs):
        for place in range(len(self.stack) - 1, -1, -1):
            name = self.out[self.stack[place]][0]
            if name in markup.ENDS.get(tag, ()):
                del self.stack[place:]
                break
            if name in markup.SCOPE and name not in markup.ENDS.get(tag, ()):
                break
        nearest = lambda tags: next((n for n in reversed(self.stack) if self.out[n][0] in tags), None)
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.out.append((tag, self.stack[-1] if self.stack else None, nearest(NEAR["row"]), nearest(NEAR["article"]), first))
        if tag not in markup.VOID:
            self.stack.append(len(self.out) - 1)

    def handle_endtag(self, tag):
        for place in range(len(self.stack) - 1, -1, -1):
            if self.out[self.stack[place]][0] == tag:
                del self.stack[place:]
                return


def plain(text):
    p = Plain()
    p.feed(text or "")
    p.close()
    return p.out


def broken(seed):
    r = random.Random(seed)
    tags = ["p", "li", "ul", "div", "a", "b", "tr", "td", "table", "article", "h2", "br", "img", "section", "dt", "dd"]
    bits = [lambda: f"<{r.choice(tags)}>", lambda: f"</{r.choice(tags)}>", lambda: f'<a href="x{r.randrange(9)}" class=\'q>"\'>', lambda: f"<A HREF=/y{r.randrange(9)}>", lambda: "some  text &amp; more ", lambda: "<br/>", lambda: "<!-- <a href='no'> -->", lambda: "<script>var a = '<p>';</script>"]
    return "".join(r.choice(bits)() for _ in range(r.randint(0, 120)))


@pytest.fixture(scope="module")
def pages(spark):
    texts = [broken(k) for k in range(150)] + [None, "", "no markup", "<", "<a", "a < b <p>c", "<li>" * 3000, "<div>" * 3000 + "<a href=z>deep"]
    return spark.createDataFrame([(k, "http://h.example/d/e?q#f", t) for k, t in enumerate(texts)], "page_id long, url string, html string")


def test_tree(spark, pages):
    given = pages.union(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select((F.col("page_id") + 10_000), "url", "html"))
    got = {}
    for r in markup.elements(given, "page_id", "html", "url", near=NEAR).collect():
        got.setdefault(r.page_id, []).append((r.n, r.tag, r.parent, r.near["row"], r.near["article"], r.attributes, r.address))
    for r in given.collect():
        want = [(n, *x, urljoin(r.url or "", x[4]["href"].strip()) if "href" in x[4] else None) for n, x in enumerate(plain(r.html))]
        assert sorted(got.get(r.page_id, []), key=lambda x: x[0]) == want, r.page_id


def test_anchors_know_their_row_and_section(spark):
    page = "<base href=/b/><h1>Top</h1><table><tr><td>One<td><a href='f.pdf'>F <b>x</b></a></table><h2> Second\n part</h2><a href=../g>G</a><div>Long " + "w " * 300 + "<a href='//o.example/h'>H</a>"
    df = spark.createDataFrame([(1, "https://h.example/a/c", page)], "page_id long, url string, html string")
    got = [tuple(r)[2:] for r in markup.anchors(df, "page_id", "html", "url").orderBy("n").collect()]
    assert got[0] == ("https://h.example/b/f.pdf", "F x", "One F x", "Top")
    assert got[1] == ("https://h.example/g", "G", "", "Second part")
    assert got[2][:2] == ("https://o.example/h", "H") and got[2][2].startswith("Long w w") and len(got[2][2]) == 180
    assert markup.anchors(df, "page_id", "html", "url", r"\.pdf$").count() == 1


def test_details(spark, pages):
    page = "<h1>No</h1><article><h1>Title <i>x</i></h1><time datetime=''>1 May</time><time>later</time><a href='/documents/methodology/9'>Soil , </a></article><a href='http://x/standards/402.4_V2.1_LUF_AB_name.pdf'>"
    df = pages.union(spark.createDataFrame([(900, "u", page)], pages.schema))
    found = {r.page_id: tuple(r)[1:] for r in markup.details(df, "page_id", "html", "url").collect()}
    assert found[900] == ("Title x", "1 May", "http://x/standards/402.4_V2.1_LUF_AB_name.pdf", "402-4", "2.1", "LUF_AB", ["Soil"])
    assert len(found) == df.count() and found[150] == ("", "", "", "", "", "", [])


def test_a_page_of_many_elements_takes_time_in_proportion(spark):
    page = "<ul>" + "".join(f"<li><div><a href='/{k}'>{k}</a></div>" for k in range(60_000))
    df = spark.createDataFrame([(1, "http://h.example/", page)], "page_id long, url string, html string")
    assert markup.anchors(df, "page_id", "html", "url").where("text = row").count() == 60_000
