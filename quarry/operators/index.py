"""Inverted index and clause tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import codes, text

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Index:
    """postings(term, doc, tf), stats(doc, dl) of every document, terms(term, df, idf), totals(n, avgdl): one row.

    texts: the documents' texts alone, to count some terms by; None where a document is several rows, or the index is read from files.
    """

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame
    totals: DataFrame
    texts: DataFrame | None = None


def build(docs: DataFrame, doc: str, column: str, parts: bool = False) -> Index:
    """Index of a table (R01, A01): empty documents count in n and avgdl; repeats of a term count in tf.

    Only ids and terms are shuffled, never texts; a document's terms are summed before the shuffle.
    A document is one row.  parts: the rows of a key are parts of one document, which a line end would part,
    so that its words are those of its parts (R04 to R07).
    """
    words = docs.select(F.col(doc).alias("doc"), text.tokens(F.col(column)).alias("w"))
    stats = words.select("doc", F.size("w").cast("long").alias("dl"))
    if parts:
        stats = stats.groupBy("doc").agg(F.sum("dl").alias("dl"))
    postings = words.select("doc", F.explode("w").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))
    totals = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = (postings if parts else words.select(F.explode(F.array_distinct("w")).alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = df.crossJoin(F.broadcast(totals)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row
    return Index(postings, stats, terms, totals, None if parts else docs.select(column))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def clauses(methods: DataFrame) -> DataFrame:
    """One row a clause (Q01): each non-blank bullet under its original place, and single texts, blanks dropped.

    methods: code, registry, title, typical, bullets array, parameters array, baseline.
    """
    head = methods.select("code", codes.registry(F.col("code"), F.col("registry")).alias("registry"), "title", "typical", "bullets", "parameters", "baseline")
    made = lambda kind, key, value: head.select(F.concat("code", F.lit(key)).alias("clause_id"), "code", "registry", F.lit(kind).alias("clause_type"), value.alias("clause_text"))
    many = head.select("code", "registry", F.posexplode("bullets").alias("pos", "clause_text")).select(
        F.concat("code", F.lit("-app-"), F.col("pos") + 1).alias("clause_id"), "code", "registry", F.lit("applicability").alias("clause_type"), "clause_text"
    )
    rest = [made("title", "-title", F.col("title")), made("typical_projects", "-typical", F.col("typical")), made("parameters", "-parameters", F.array_join("parameters", " | ")), made("baseline_scenario", "-baseline", F.col("baseline"))]
    out = many
    for r in rest:
        out = out.unionByName(r)
    return out.where(F.trim("clause_text") != "")


def joined_text(docs: DataFrame, key: str, pos: str, column: str, lower: bool = False) -> DataFrame:
    """All texts of a key in order, parted by line ends (Q03)."""
    own = F.lower(column) if lower else F.col(column)
    return docs.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), own.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def mean_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Mean vector of each key (A08), summed place by place before the shuffle."""
    each = vectors.select(key, F.posexplode(column).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def _as_vector(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.withColumn("_vector", array_to_vector(F.col(column).cast("array<double>")))


def fit_pca(vectors: DataFrame, key: str, column: str, dims: int, sample: int = 1000, seed: int = 42) -> PipelineModel:
    """Centring and principal components (R14), fitted on a seeded sample of ``sample`` vectors, dims + 64 at least.

    The sample is those whose digest of seed and key comes first, so it does not
    depend on partitioning; null vectors are left out.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    some = _as_vector(vectors.where(F.col(column).isNotNull()).orderBy(order, key).limit(max(sample, dims + 64)).select(column), column)
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="_vector", outputCol="_centred"), PCA(k=dims, inputCol="_centred", outputCol="_reduced")]).fit(some)


def reduced(vectors: DataFrame, model: PipelineModel, column: str) -> DataFrame:
    """Adds the array ``reduced`` of every vector (R14); the model may come from a file."""
    full = _as_vector(vectors.where(F.col(column).isNotNull()), column)
    return model.transform(full).withColumn("reduced", vector_to_array("_reduced")).drop("_vector", "_centred", "_reduced")
