"""Extraction by a model under a strict schema: answers that do not fit go to a side table and are asked for again with the error."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as X

from quarry.functions import codes
from quarry.sources import landed

from .sections import json_part

Transport = Callable[[list[str]], list[str | None]]
#: Times that a document is asked about, at most.
ATTEMPTS = 3
#: Signs of an answer that the side table and the next prompt keep.
KEPT = 500

FEATURES = "ghg array<string>, technology string, country_iso string, scale string"
CAPACITY = "capacity_mw double, stated boolean, quote string, unit_raw string"


def fault(answer: Column, fields: X.StructType) -> tuple[Column, Column]:
    """(struct of the fields, error) of an answer: its JSON object must have every field, null or of its type, and no other type."""
    part = json_part(answer)
    parsed = F.from_json(part, X.StructType([*fields, X.StructField("_bad", X.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys(part)
    lacking = [F.when(~F.array_contains(keys, f.name), F.lit(f"the field {f.name} is missing")) for f in fields]
    error = F.coalesce(F.when(answer.isNull(), "no answer"), F.when(part.isNull(), "no JSON object"), *lacking, F.when(parsed["_bad"].isNotNull(), f"not of the schema {fields.simpleString()}"))
    return F.struct(*(parsed[f.name].alias(f.name) for f in fields)), error


def extracted(docs: DataFrame, id: str, prompt: Column, schema: str, transport: Transport, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): for each id the fields of ``schema``, attempts and ok; and a row (id, attempt, answer, error) for each answer that did not fit.

    The transport maps a batch of prompts to answers; an error of it is no answer for its
    batch.  What does not fit is asked again, with the answer and what was wrong with it, up
    to ``attempts`` times; then the id has nulls and ok is false.  Each round's answers are
    written before they are read, so a model is never asked twice for one round.  Ids must be
    unique; every input has a row; an empty table asks nothing.
    """
    spark, fields = docs.sparkSession, X.StructType.fromDDL(schema)
    kind = docs.schema[id].dataType.simpleString()
    pending = docs.select(F.col(id).alias("id"), prompt.alias("prompt"), prompt.alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                said = transport(b["asked"].tolist())
            except Exception:  # a remote model's failure is no answer, and is asked again
                said = [None] * len(b)
            yield pd.DataFrame({"id": b["id"], "prompt": b["prompt"], "answer": said})

    rounds = []
    for attempt in range(1, attempts + 1):
        path = landed.folder(spark)
        value, error = fault(F.col("answer"), fields)
        answers = pending.mapInPandas(run, f"id {kind}, prompt string, answer string")
        answers.select("id", "prompt", F.lit(attempt).alias("attempt"), "answer", value.alias("value"), error.alias("error")).write.parquet(path)
        done = spark.read.parquet(path)
        rounds.append(done)
        again = F.concat_ws("\n\n", "prompt", F.concat(F.lit("Your answer was: "), F.substring(F.coalesce("answer", F.lit("")), 1, KEPT)), F.concat(F.lit("It does not fit: "), "error"))
        pending = done.where("error IS NOT NULL").select("id", "prompt", again.alias("asked"))
    every = reduce(DataFrame.union, rounds)
    last = rounds[-1].where("error IS NOT NULL").select("id", F.lit(attempts).alias("attempts"), F.lit(False).alias("ok"), F.lit(None).cast(fields).alias("value"))
    good = every.where("error IS NULL").select("id", F.col("attempt").alias("attempts"), F.lit(True).alias("ok"), "value")
    rows = good.union(last).select(F.col("id").alias(id), "attempts", "ok", "value.*")
    return rows, every.where("error IS NOT NULL").select(F.col("id").alias(id), "attempt", F.substring("answer", 1, KEPT).alias("answer"), "error")


def features(docs: DataFrame, id: str, text: str, transport: Transport) -> tuple[DataFrame, DataFrame]:
    """Project features (L04) by the rules of D06: allowed gases, technology slug, country and scale; null fields are empty or unknown."""
    ask = F.concat(F.lit(f"Answer with a JSON object of exactly these fields: {FEATURES}.\n\n"), F.coalesce(F.col(text), F.lit("")))
    rows, bad = extracted(docs, id, ask, FEATURES, transport)
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    ghg = F.array_distinct(codes.gases(F.coalesce("ghg", F.array().cast("array<string>"))))
    return rows.select(id, "attempts", "ok", ghg.alias("ghg"), codes.technology(some("technology")).alias("technology"), codes.country(some("country_iso")).alias("country"), codes.scale(some("scale")).alias("scale")), bad


def capacities(docs: DataFrame, id: str, text: str, transport: Transport) -> tuple[DataFrame, DataFrame]:
    """Stated capacities (L05): one counts as stated only with a quote that stands in the text."""
    ask = F.concat(F.lit(f"Answer with a JSON object of exactly these fields: {CAPACITY}.\n\n"), F.coalesce(F.col(text), F.lit("")))
    rows, bad = extracted(docs, id, ask, CAPACITY, transport)
    both = rows.join(docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), F.col(id) == F.col("_id"))
    quote = F.substring(F.trim(F.coalesce("quote", F.lit(""))), 1, 200)
    stated = F.coalesce("stated", F.lit(False)) & (quote != "") & F.contains("_text", quote)
    return both.select(id, "attempts", "ok", "capacity_mw", stated.alias("stated"), quote.alias("quote"), F.substring(F.coalesce("unit_raw", F.lit("")), 1, 40).alias("unit_raw")), bad
