"""Second pass of redaction: paragraphs that were marked go to a verifier, and its answers are spliced back in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sections import mask_sentences

#: Paragraphs -> for each (leaks, evidence, redacted paragraph), or None where it has no answer; an error leaves its batch as it is.
Verifier = Callable[[list[str]], list[tuple[bool, str, str] | None]]
#: Signs that a paragraph has at least.
LEAST = 30


def pieces(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, pos, start, head, value, tail) of every stretch between blank lines: head + value + tail, in order, are the text.

    value is the stretch without white space at its ends, start its offset in the text (a
    running sum of lengths), tail the white space after it with the blank lines.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    gaps = F.regexp_extract_all(t, F.lit(r"\n\s*\n"), F.lit(0))
    zipped = F.arrays_zip(F.split(t, r"\n\s*\n", -1).alias("part"), gaps.alias("gap"))
    cut = docs.select(id, F.posexplode(zipped).alias("pos", "x")).select(id, "pos", F.col("x.part").alias("_part"), F.coalesce("x.gap", F.lit("")).alias("_gap"))
    before = Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    head, tail = F.regexp_extract("_part", r"^(\s*)", 1), F.regexp_extract("_part", r"(?s)^.*?(\s*)\z", 1)
    value = F.regexp_replace("_part", r"^\s+|\s+\z", "")
    at = F.coalesce(F.sum(F.length("_part") + F.length("_gap")).over(before), F.lit(0))
    blank = value == ""
    return cut.select(
        id, "pos", (at + F.length(head)).cast("int").alias("start"), head.alias("head"), value.alias("value"), F.concat(F.when(blank, "").otherwise(tail), "_gap").alias("tail")
    )


def verified(docs: DataFrame, id: str, text: str, verifier: Verifier, only_marked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(texts, marks) after the second pass.

    texts: id, text, n_asked, n_replaced.  Paragraphs of at least LEAST signs that hold an
    offset of a reference (both ends count), or all of them, are shown to the verifier in
    batches; those that leak, with evidence, are replaced where they stand, in order, whatever
    else reads alike.  marks: id, pos, evidence, before, after (200 signs), start, end: the
    place of the replacement in the new text, its old place shifted by all that earlier ones
    grew or shrank (a running sum).  Ids must be unique; null and empty texts come back empty;
    what the verifier fails on stays.
    """
    cut = pieces(docs, id, text)
    long = cut.where(F.length("value") >= LEAST)
    if only_marked:
        marks = docs.select(F.col(id).alias("_id"), F.transform(mask_sentences(F.col(text))["marks"], lambda m: m["at"]).alias("_at"))
        inside = F.exists("_at", lambda a: (a >= F.col("start")) & (a <= F.col("start") + F.length("value")))
        long = long.join(marks.where(F.size("_at") > 0), F.col(id) == F.col("_id")).where(inside)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                said = verifier(b["value"].tolist())
            except Exception:  # a remote verifier's failure leaves the first pass as it is
                said = [None] * len(b)
            rows = [x or (False, "", "") for x in said]
            yield pd.DataFrame({"id": b["id"], "pos": b["pos"], "leaks": [bool(x[0]) for x in rows], "evidence": [x[1] or "" for x in rows], "new": [x[2] for x in rows]})

    asked = long.select(F.col(id).alias("id"), "pos", "value").mapInPandas(run, f"id {docs.schema[id].dataType.simpleString()}, pos int, leaks boolean, evidence string, new string")
    answers = asked.select(F.col("id").alias("_answered"), F.col("pos").alias("_pos"), (F.col("leaks") & (F.col("evidence") != "")).alias("_leaks"), "evidence", "new")
    both = cut.join(answers, (F.col(id) == F.col("_answered")) & (F.col("pos") == F.col("_pos")), "left").withColumn("_leaks", F.coalesce("_leaks", F.lit(False)))
    now = F.when(F.col("_leaks"), F.col("new")).otherwise(F.col("value"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("head", now, "tail").alias("t")))), lambda x: x["t"]), "")
    texts = both.groupBy(id).agg(whole.alias("text"), F.count("_answered").alias("n_asked"), F.count_if("_leaks").alias("n_replaced"))
    before = Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("new") - F.length("value")).over(before), F.lit(0))
    moved = both.where("_leaks").withColumn("start", (F.col("start") + shift).cast("int"))
    return texts, moved.select(id, "pos", "evidence", F.substring("value", 1, 200).alias("before"), F.substring("new", 1, 200).alias("after"), "start", (F.col("start") + F.length("new")).alias("end"))
