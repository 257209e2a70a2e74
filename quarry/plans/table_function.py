"""Recommendation as a table function of SQL: one row of a candidate in, the best codes of each query out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as X
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: What the table argument must have, and of which types.
NEEDED = {"qid": (X.LongType, X.IntegerType), "channel": (X.StringType,), "code": (X.StringType,), "score": (X.DoubleType, X.FloatType)}
RESULT = "qid long, code string, score double, rank int"


class RecommendCodes:
    """recommend_codes(TABLE(candidates), top, weights) -> qid, code, score, rank.

    ``candidates`` has qid, channel, code and score (more columns are let be), best one row for
    each; ``weights`` is a map of channels.  Channels are scaled to 0..1 within a query (all 0 where
    scores are equal), weighted and summed; ties go to the smaller code: the rows of fusion.fuse.
    The function asks for its rows by query, so one call holds the candidates of one query; null
    queries are one, null codes and scores and channels without a weight count for nothing.
    """

    @staticmethod
    def analyze(candidates: AnalyzeArgument, top: AnalyzeArgument, weights: AnalyzeArgument) -> AnalyzeResult:
        if not candidates.isTable:
            raise ValueError("the first argument must be TABLE(...)")
        held = {f.name: type(f.dataType) for f in candidates.dataType.fields}
        for name, kinds in NEEDED.items():
            if held.get(name) not in kinds:
                raise ValueError(f"the table needs a column {name} of type {' or '.join(k.typeName() for k in kinds)}, found {held[name].typeName() if name in held else 'none'}")
        if not isinstance(top.dataType, X.IntegerType) or not top.isConstantExpression or top.value is None or top.value < 1:
            raise ValueError("top must be a positive whole number")
        if not isinstance(weights.dataType, X.MapType):
            raise ValueError("weights must be a map of channels")
        schema = X.StructType([X.StructField("qid", X.LongType()), X.StructField("code", X.StringType()), X.StructField("score", X.DoubleType()), X.StructField("rank", X.IntegerType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("qid")], orderBy=[OrderingColumn("channel"), OrderingColumn("code")])

    def __init__(self):
        self.qid, self.top, self.weights, self.channels = None, 0, {}, {}

    def eval(self, candidates, top: int, weights: dict) -> None:
        self.qid, self.top, self.weights = candidates["qid"], top, weights
        if candidates["code"] is not None and candidates["score"] is not None and weights.get(candidates["channel"]):
            self.channels.setdefault(candidates["channel"], []).append((candidates["code"], float(candidates["score"])))

    def terminate(self) -> Iterator[tuple]:
        total: dict[str, float] = {}
        for channel, rows in self.channels.items():
            low, high = min(s for _, s in rows), max(s for _, s in rows)
            for code, score in rows:
                scaled = (score - low) / (high - low) if high - low >= 1e-9 else 0.0
                total[code] = total.get(code, 0.0) + float(self.weights[channel]) * scaled
        for rank, (code, score) in enumerate(sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))[: self.top], 1):
            yield self.qid, code, score, rank


def register(spark: SparkSession, name: str = "recommend_codes") -> None:
    """Makes the function known to SQL of this session."""
    spark.udtf.register(name, udtf(RecommendCodes))
