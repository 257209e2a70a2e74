"""Column functions on text: tokens, paragraphs, redaction patterns, headings, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z][A-Za-z0-9]{2,}"

# Words that scoring leaves out.
STOP_WORDS = (
    "the and for are with that this from have has been shall will may can must should would could any all such these those their there "
    "they them which where when what who whose while into onto upon over under between through during above below without within against "
    "before after but not nor only also however therefore thus more most less least much some each every both other another either neither "
    "same different new old one two three four five year years day days month months table figure section annex appendix page"
).split()

MASK = "[REDACTED:METHODOLOGY_REF]"

# Patterns of methodology references, in the order in which they apply.
REDACTION = (
    ("AR-AMS-Roman", r"(?i)\bAR[-\s]?AMS[-\s]*[IVX]{1,5}\b"),
    ("AR-AM####", r"(?i)\bAR[-\s]?AM\d{4}\b"),
    ("AR-ACM####", r"(?i)\bAR[-\s]?ACM\d{4}\b"),
    ("ACM####", r"\bACM\d{4}\b"),
    ("AM####", r"\bAM\d{4}\b"),
    ("AMS-Roman", r"(?i)\bAMS[-\s]*[IVX]{1,5}(?:\.[A-Z]{1,3})?\.?"),
    ("VMR####", r"\bVMR\d{4}\b"),
    ("VMD####", r"\bVMD\d{4}\b"),
    ("VM####", r"\bVM\d{4}\b"),
    ("VT####", r"\bVT\d{4}\b"),
    ("TPDDTEC", r"(?i)\bTPDDTEC\b"),
    ("GS-VER", r"(?i)\bGS[-\s]*VER\d*\b"),
    ("GS-XX-###", r"(?i)\bGS-(?:EN|AG|WA|FW|LU|FS|HI|EE|RE|WM|WMH|OTH|FO|TR|CS|BCFW|FM|ICS|ESG|MS)-\d{2,4}\b"),
    ("GS-Passport-#", r"(?i)\bGS[-\s]?Passport\b"),
    ("verbose-METHODOLOGY-FOR-...-V #", r"(?i)\bMethodology\s+(?:for|to)\s+[^.\n]{10,200}\b(?:V|version)\s*\d+(?:\.\d+)?\b"),
)

#: Where a sentence ends: stop and capital, blank line, end of a table row or table.
BOUNDARY = r"(?:[.!?](?:\s|[)\"”])+(?=[A-Z\"“(\[])|\n\s*\n|</tr>|</table>)"

TOC_LINE = r"(?m)^[^\n]*?\.{8,}\s*\d+\s*$\n?"
PAGE_HEADERS = (r"(?i)Project\s+Description:?\s+VCS\s+Version\s+[\d.]+", r"(?i)<!--\s*PAGE\s+BREAK\s*-->")
# Fixed value: a stated capacity.
CAPACITY = r"(?i)\d+(?:\.\d+)?\s*[MkG]W(?:e|th|p)?\b"


def tokens(text: Column) -> Column:
    """Lower-cased words of three letters or digits or more, stop words left out, repeats kept (T01); null has none."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def strip_toc(text: Column) -> Column:
    """Text without lines of dot leaders and a page number."""
    return F.regexp_replace(text, TOC_LINE, "")


def strip_headers(text: Column) -> Column:
    """Text without recurring page headers."""
    for p in PAGE_HEADERS:
        text = F.regexp_replace(text, p, "")
    return text


def paragraphs(text: Column, least: int = 30) -> Column:
    """Trimmed paragraphs by blank lines of at least ``least`` signs."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= least)


def mask_words(text: Column) -> Column:
    """Each reference replaced by MASK, pattern after pattern."""
    for _, p in REDACTION:
        text = F.regexp_replace(text, p, F.lit(MASK.replace("$", r"\$")))
    return text


def marks(text: Column) -> Column:
    """Counts by pattern of the references in the original text, as array<struct<pattern,n>>."""
    return F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for n, p in REDACTION])


def clean_markup(html: Column) -> Column:
    """Text without page breaks and tags, white space folded."""
    x = F.regexp_replace(html, r"(?i)<!--\s*page\s+break\s*-->", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def json_object(text: Column) -> Column:
    """The greedy {...} part of a noisy text (D20); null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def choice(text: Column, first: Column, second: Column) -> Column:
    """Which of two candidates an answer names (D19): the word after ``CHOICE:`` without ``.,;:`` at its ends, else the one that alone occurs; null if neither."""
    word = F.regexp_replace(F.regexp_extract(text, r"(?i)CHOICE\s*:\s*(\S+)", 1), r"^[.,;:]+|[.,;:]+$", "")
    alone = lambda a, b: F.contains(text, a) & ~F.contains(text, b)
    return F.when((word == first) | (word == second), word).when(alone(first, second), first).when(alone(second, first), second)
