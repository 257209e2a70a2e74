"""Recommenders: retrieval and fusion in one plan, a prompt, a pluggable model, and its answer checked.

A transport maps a batch of prompts to answers; without one the fused order stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import filters, fusion, index, retrieve
from quarry.operators.sections import json_part
from quarry.sources import landed

Transport = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Config:
    """What the systems differ in."""

    alpha: float = 0.5
    beta: float = 0.5
    candidates: int = 15
    top: int = 5
    budget: int = 12_000
    masked: bool = False
    prior: float = 0.0
    rerank: bool = True


#: Named systems.
SYSTEMS = {
    "fusion_only": Config(rerank=False),
    "naive_rag": Config(alpha=1.0, beta=0.0, budget=8_000),
    "v1": Config(budget=8_000),
    "v2": Config(),
    "v2_5": Config(candidates=20),
    "v2_8_masked": Config(masked=True),
    "v3_prior": Config(prior=0.15),
}


def candidates(queries: DataFrame, docs: DataFrame, config: Config, second: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, code, score, rank) of queries(qid, text) over docs(doc, code, text); second is another channel (qid, code, score)."""
    ix = index.build(docs, "doc", "text")
    s = retrieve.bm25_by_key(queries, docs, ix, "qid", "doc", "text", "code", allowed if config.masked else None)
    channels = [(landed.kept(s.select("qid", F.col("key").alias("code"), F.col("best").alias("score"))), config.alpha)]
    if second is not None and config.beta:
        channels.append((second, config.beta))
    fused = fusion.fuse(channels, config.candidates)
    if not config.prior:
        return fused
    share = docs.groupBy("code").agg(F.count(F.lit(1)).alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy()))  # code-sized
    return retrieve.top(fused.join(share, "code", "left").select("qid", "code", (F.col("score") + config.prior * F.coalesce("p", F.lit(0.0))).alias("score")), config.candidates, "code")


def prompts(queries: DataFrame, ranked: DataFrame, config: Config) -> DataFrame:
    """(qid, prompt): the candidates under the budget and the text."""
    lines = ranked.select("qid", "rank", F.concat_ws(" ", F.concat(F.col("rank"), F.lit(".")), "code").alias("line"))
    block = fusion.budgeted(lines, "qid", "rank", "line", config.budget)
    ask = 'Answer with JSON {"codes": [...]}, the best first.'
    return queries.join(block, "qid").select("qid", F.concat_ws("\n\n", F.lit(ask), "block", "text").alias("prompt"))


def answered(asked: DataFrame, transport: Transport) -> DataFrame:
    """(qid, answer); a batch that the transport fails on has null answers and falls back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = transport(b["prompt"].tolist())
            except Exception:  # a remote model's failure degrades to the fused order
                got = [None] * len(b)
            yield pd.DataFrame({"qid": b["qid"], "answer": got})

    return asked.mapInPandas(run, "qid long, answer string")


def recommend(queries: DataFrame, docs: DataFrame, config: Config, second: DataFrame | None = None, allowed: DataFrame | None = None, transport: Transport | None = None) -> DataFrame:
    """(qid, code, score, rank): the model's valid codes, then the fused order where it gave none."""
    ranked = candidates(queries, docs, config, second, allowed)
    fallback = ranked.where(F.col("rank") <= config.top).select("qid", "code", "score", "rank")
    if transport is None or not config.rerank:
        return fallback
    answers = answered(prompts(queries, ranked, config), transport).select("qid", F.from_json(json_part("answer"), "codes array<string>")["codes"].alias("codes"))
    said = answers.select(F.col("qid").alias("gid"), F.posexplode("codes").alias("pos", "code")).withColumn("pos", F.col("pos") + 1)
    valid = filters.valid_labels(said, docs.select("code").distinct(), config.top).select(F.col("gid").alias("qid"), "code", "score", "rank")
    return valid.union(fallback.join(valid.select("qid").distinct(), "qid", "left_anti"))


def with_options(name: str, **options) -> Config:
    return replace(SYSTEMS[name], **options)
