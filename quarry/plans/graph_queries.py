"""Queries of the graph of methods, clauses, thresholds and documents, with edges made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.graph import Step

from .registry import query, rows, table

# A document is a clause of one of fifty methods, and a method revises another: revisions run into cycles.
METHODS = 50
REVISES = f"SELECT DISTINCT concat('M', CAST(p_partkey % {METHODS} AS STRING)) AS src, 'revises' AS kind, concat('M', CAST(((p_partkey % {METHODS}) * (p_partkey % {METHODS}) + 1) % {METHODS} AS STRING)) AS dst FROM part"
CLAUSES = f"SELECT concat('D', CAST(doc_id AS STRING)) AS src, 'clause_of' AS kind, concat('M', CAST(doc_id % {METHODS} AS STRING)) AS dst FROM documents"
# A part's size is a threshold of its supplier's, and an order with the part the document that states it.
APPLIES = "SELECT concat('T', CAST(l_partkey AS STRING)) AS src, 'threshold_applies_to' AS kind, concat('S', CAST(l_suppkey AS STRING)) AS dst FROM lineitem"
STATED = "SELECT concat('O', CAST(l_orderkey AS STRING)) AS src, 'guidance_source_of' AS kind, concat('T', CAST(l_partkey AS STRING)) AS dst FROM lineitem"
THRESHOLDS = "SELECT concat('T', CAST(p_partkey AS STRING)) AS id, p_type AS ssc_type, CASE WHEN p_size % 2 = 0 THEN 'capacity' ELSE 'savings' END AS dimension, CAST(p_size AS BIGINT) AS cap, CASE WHEN p_size % 2 = 0 THEN 'MW' ELSE 'GWh' END AS unit FROM part"


@query(
    "S15_graph_clauses",
    f"""WITH RECURSIVE e AS ({REVISES}), c AS ({CLAUSES}), r(code, method) AS (SELECT DISTINCT dst, dst FROM c UNION SELECT code, e.dst FROM r JOIN e ON e.src = r.method)
    SELECT code, method, c.src AS clause, CAST(length(text) AS INT) AS n_chars, sha256(text) AS digest FROM r JOIN c ON c.dst = r.method JOIN documents ON concat('D', CAST(doc_id AS STRING)) = c.src WHERE text IS NOT NULL""",
)
def graph_clauses(spark, sf_dir):
    """Clause texts of each method and of those that it revises, directly or not."""
    clauses = rows(spark, sf_dir, CLAUSES)
    edges = clauses.unionAll(rows(spark, sf_dir, REVISES))
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))
    paths = graph.match(clauses.select(F.col("dst").alias("code")), edges, [Step("revises", "method", any=True), Step("clause_of", "clause", back=True)])
    return graph.described(paths, "clause", texts, "id").select("code", "method", "clause", "n_chars", "digest")


@query(
    "S16_graph_thresholds",
    f"""WITH a AS ({APPLIES}), g AS ({STATED}), t AS ({THRESHOLDS}), m AS (SELECT a.dst AS code, ssc_type, dimension, cap, unit, g.src AS document FROM a JOIN t ON t.id = a.src JOIN g ON g.dst = a.src)
    SELECT code, ssc_type, dimension, cap, unit, document FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY document, ssc_type, dimension, cap, unit) AS k FROM m) WHERE k = 1""",
)
def graph_thresholds(spark, sf_dir):
    """A threshold of each code with the document that states it: that of the least document, so of each threshold's documents only the least is followed."""
    applies = rows(spark, sf_dir, APPLIES)
    edges = applies.unionAll(rows(spark, sf_dir, STATED))
    paths = graph.match(applies.select(F.col("dst").alias("code")), edges, [Step("threshold_applies_to", "threshold", back=True), Step("guidance_source_of", "document", back=True, least=True)])
    found = graph.described(paths, "threshold", rows(spark, sf_dir, THRESHOLDS), "id").drop("threshold")
    return graph.first_of(found, "code", ["document", "ssc_type", "dimension", "cap", "unit"])
