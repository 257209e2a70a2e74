"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points before and after a span in which context words count.
CONTEXT = 40
#: Score from which an added span is kept.
KEEP = 0.5
#: Matches of one text whose places are summed together.
BLOCK = 128


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    pattern finds candidates; check names the test that they must pass; base spans
    are kept whatever their score, others from KEEP on; words raise the score.
    """

    name: str
    pattern: str
    check: str
    base: bool
    prior: float
    words: tuple[str, ...]


# The base patterns match what the contract's do, leftmost and non-overlapping.  A
# possessive quantifier never gives back what the next sign could not match anyway, and
# a match can start only where a run of its first class starts or a match ended, so
# long runs cost linear time and no stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"

KINDS = (
    Kind("email", EMAIL, "none", True, 1.0, ()),
    Kind("ip", IP, "octets", True, 1.0, ()),
    Kind("card", CARD, "luhn", True, 1.0, ()),
    Kind("phone", PHONE, "digits", True, 1.0, ()),
    Kind("iban", IBAN, "mod97", False, 0.6, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("ssn", SSN, "area", False, 0.3, ("ssn", "social security", "national id")),
    Kind("secret", SECRET, "none", False, 0.2, ("token", "secret", "key", "password", "api")),
)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn: every second digit from the right is doubled, nines cast out."""
    back = F.split(F.reverse(digits), "")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    worth = F.transform(back, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number's rearranged digits leave 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _passes(check: str, x: Column) -> Column:
    if check == "octets":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if check == "luhn":
        d = _digits(x)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if check == "digits":
        return F.length(_digits(x)).between(8, 15)
    if check == "mod97":
        return mod97(x)
    if check == "area":
        return ~x.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches, in code points: the pieces between matches give their places.

    Sums run over blocks of BLOCK matches and then within each block, as an array that
    grows by one element a step is copied at each step.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    kind = "array<struct<start:int,end:int,value:string>>"

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        after = begin + F.length(x["value"])
        return F.struct(after.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), after.alias("end"), x["value"].alias("value")))).alias("out"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])

    def blocked(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
        length = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["value"]))
        starts = F.aggregate(
            blocks, F.array(F.lit(0)), lambda s, block: F.concat(s, F.array(F.element_at(s, -1) + length(block)))
        )
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), placed))

    few = F.size(sizes) <= BLOCK
    return F.when(few, placed(sizes, F.lit(0))).otherwise(blocked(sizes))


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind with their scores."""
    passed = F.filter(_located(text, kind.pattern), lambda s: _passes(kind.check, s["value"]))

    def scored(s: Column) -> Column:
        score = F.lit(kind.prior)
        if kind.words:
            low = F.greatest(s["start"] - CONTEXT, F.lit(0))
            near = F.lower(F.concat(F.substring(text, low + 1, s["start"] - low), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(CONTEXT))))
            score = score + F.when(near.rlike("(?<![a-z])(?:" + "|".join(kind.words) + ")(?![a-z])"), 0.4).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    out = F.transform(passed, scored)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= KEEP)


def find(docs: DataFrame, *, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, score), by kind as listed and then by start; code points, end exclusive.

    Patterns propose spans; card numbers must pass Luhn, account numbers mod 97,
    addresses and telephone numbers their ranges; words within CONTEXT code points raise
    the score of the added kinds (account, social security and secret), which stay
    from KEEP on.  Base kinds stay whatever their score.  Base kinds may overlap
    others, not themselves.

    Rows are independent: no shuffle.  Edge cases: null and empty texts have no
    spans; repeated rows get their spans each; a column named ``spans`` is replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    hints = {"email": "@", "phone": "+", "ip": "."}
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    parts = []
    for kind in kinds:
        spans = _spans(value, kind)
        # most texts lack the sign that a kind needs; the rest of the expression is then not evaluated
        needs = F.contains(value, F.lit(hints[kind.name])) if kind.name in hints else value.rlike("[0-9]{2}|[0-9][ -][0-9]")
        parts.append(F.when(needs, spans).otherwise(none))
    return docs.withColumn("spans", F.concat(*parts))


def mask(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``spans`` in ``text`` replaced by its kind in brackets; overlapping spans become one.

    The kind of the span that starts first (then the longest) names the replacement.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    row = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end = -x["far"]
        piece = F.concat(s["out"], F.substring(value, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        fresh = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], end).alias("at"), F.when(fresh, piece).otherwise(s["out"]).alias("out"))

    masked = F.aggregate(row, start, step, lambda s: F.concat(s["out"], F.substring(value, s["at"] + 1, F.length(value))))
    return docs.withColumn(text, F.when(F.size("spans") > 0, masked).otherwise(F.col(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select(
        "doc_id", *map(count, base), F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
