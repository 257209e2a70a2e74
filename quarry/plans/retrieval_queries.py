"""Queries of the index, retrieval and fusion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import keywords, text
from quarry.operators import fusion, index, own_rank, retrieve, vector_index

from quarry.sources import landed

from .code_queries import CANDIDATES, pick
from .registry import SPLICED, query, rows, table

STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def tok(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{text.TOKEN}'), lambda t: lower(t)), lambda t: NOT list_contains({STOPS}, t))"


#: Scores of every benchmark item and document that share a term.
SCORED = f"""
w AS (SELECT doc_id, {tok('text')} w FROM documents),
stats AS (SELECT doc_id, len(w) dl FROM w),
tot AS (SELECT count(*) n, avg(dl) avgdl FROM stats),
post AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest(w) term FROM w) GROUP BY ALL),
terms AS (SELECT term, count(*) df FROM post GROUP BY 1),
qt AS (SELECT qid, term, count(*) qtf FROM (SELECT item_id qid, unnest({tok('text')}) term FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(1, avgdl)))) score
      FROM qt JOIN post USING (term) JOIN terms USING (term) JOIN stats USING (doc_id), tot GROUP BY ALL)
"""
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) rank FROM s)"


def summed(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The scores of every benchmark item and document that share a term, summed by a key and written once: as many rows as items and keys."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return landed.kept(retrieve.bm25_by_key(items, docs, index.build(docs, "doc_id", "text"), "item_id", "doc_id", "text", key))


@query("T01_tokenize", f"SELECT doc_id, CAST(len({tok('text')}) AS BIGINT) AS n_tokens, array_to_string({tok('text')}[1:20], ' ') AS head FROM documents")
def tokenize(spark, sf_dir):
    w = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.array_join(F.slice(w, 1, 20), " ").alias("head"))


@query("A01_document_statistics", f"WITH {SCORED} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, (SELECT CAST(count(*) AS BIGINT) FROM terms) AS n_terms, (SELECT CAST(max(df) AS BIGINT) FROM terms) AS max_df FROM tot")
def document_statistics(spark, sf_dir):
    ix = index.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    terms = ix.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.max("df").alias("max_df"))
    return ix.totals.crossJoin(terms).select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms", "max_df")  # one row each


@query("R01_bm25_index", f"WITH {SCORED} SELECT term, CAST(df AS BIGINT) AS df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM terms, tot")
def bm25_index(spark, sf_dir):
    return index.build(table(spark, sf_dir, "documents"), "doc_id", "text").terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("R02_bm25_score", f"WITH {SCORED} SELECT qid, CAST(count(*) AS BIGINT) AS n_docs, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM s GROUP BY qid")
def bm25_score(spark, sf_dir):
    return summed(spark, sf_dir, "lang").groupBy("qid").agg(F.sum("n").alias("n_docs"), F.round(F.sum("total"), 4).alias("total"), F.round(F.max("best"), 6).alias("best"))


@query("R03_bm25_topk", f"WITH {SCORED}, {RANKED} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50")
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    s = retrieve.bm25_top(table(spark, sf_dir, "benchmark"), docs, index.build(docs, "doc_id", "text"), "item_id", "doc_id", "text", 50)
    return s.select("qid", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(
    "F07_masked_bm25",
    f"WITH {SCORED}, m AS (SELECT s.* FROM s JOIN documents d USING (doc_id) WHERE d.lang = 'en'), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) rank FROM m) SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 100",
)
def masked_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    allowed = docs.where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    s = retrieve.bm25_top(table(spark, sf_dir, "benchmark"), docs, index.build(docs, "doc_id", "text"), "item_id", "doc_id", "text", 100, allowed)
    return s.select("qid", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


CODE_TEXT = "c AS (SELECT source AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source)"
CODE_SCORED = SCORED.replace(f"SELECT doc_id, {tok('text')} w FROM documents", f"SELECT doc_id, {tok('text')} w FROM c")


@query("Q03_joined_text", "SELECT source, CAST(length(string_agg(text, chr(10) ORDER BY doc_id)) AS BIGINT) AS n_chars, md5(string_agg(lower(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def joined_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = index.joined_text(docs, "source", "doc_id", "text").select("source", F.length("text").cast("long").alias("n_chars"))
    two = index.joined_text(docs, "source", "doc_id", "text", lower=True).select("source", F.md5("text").alias("digest"))
    return one.join(two, "source")


@query("R04_document_bm25", f"WITH {CODE_TEXT}, {CODE_SCORED}, {RANKED} SELECT qid, doc_id AS source, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def document_bm25(spark, sf_dir):
    s = retrieve.bm25(table(spark, sf_dir, "benchmark"), index.build(table(spark, sf_dir, "documents"), "source", "text", parts=True), "item_id", "text")
    return retrieve.top(s, 5).select("qid", F.col("doc").alias("source"), F.round("score", 6).alias("score"), "rank")


TARGETS = "t AS (SELECT item_id qid, concat('src', CAST(item_id % 20 AS STRING)) target FROM benchmark)"
TARGET_RANK = "full_r AS (SELECT q.item_id qid, c.doc_id, coalesce(score, 0) score, row_number() OVER (PARTITION BY q.item_id ORDER BY round(coalesce(score, 0), 9) DESC, c.doc_id) rank FROM benchmark q CROSS JOIN c LEFT JOIN s ON s.qid = q.item_id AND s.doc_id = c.doc_id)"


@query("R05_target_rank", f"WITH {CODE_TEXT}, {CODE_SCORED}, {TARGETS}, {TARGET_RANK} SELECT qid, target, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM t JOIN full_r USING (qid) WHERE doc_id = target")
def target_rank(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    ix = index.build(table(spark, sf_dir, "documents"), "source", "text", parts=True)
    s = retrieve.bm25(items, ix, "item_id", "text")
    targets = items.select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("target"))
    return retrieve.rank_of(s, targets, ix.stats).withColumn("score", F.round("score", 6))


@query("R06_score_drop")
def score_drop(spark, sf_dir):
    """Share of a document's score for its own code that masking takes; passes from one half on."""
    scored = own_rank.own_totals(rows(spark, sf_dir, SPLICED), "code", "text", {"before": F.col("text"), "after": text.mask_words(F.col("text"))})
    drop = scored.select(F.col("key").alias("code"), F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0).alias("drop"))
    return drop.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("drop"), 6).alias("mean_drop"), F.round(F.avg((F.col("drop") >= 0.5).cast("int")), 6).alias("pass_rate"))


@query("R07_rank_leak")
def rank_leak(spark, sf_dir):
    """Rank of a document's own code before and after masking."""
    ranks = own_rank.own_ranks(rows(spark, sf_dir, SPLICED), "code", "text", {"before": F.col("text"), "after": text.mask_words(F.col("text"))})
    return ranks.select(F.col("key").alias("code"), F.col("before_rank").alias("before"), F.col("after_rank").alias("after")).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("after") == 1).cast("int")), 6).alias("top1_leak"), F.round(F.avg((F.col("after") <= 10).cast("int")), 6).alias("top10_leak"), F.round(F.avg(F.col("after") - F.col("before")), 6).alias("mean_drop")
    )


VQ = "q AS (SELECT vec_id qid, embedding qe FROM embeddings WHERE vec_id % 100 = 0)"
DENSE = f"""{VQ}, ds AS (SELECT qid, vec_id doc_id, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) score FROM q, embeddings),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) rank FROM ds)"""


def near(spark, sf_dir, k):
    v = table(spark, sf_dir, "embeddings")
    return retrieve.dense(v.where("vec_id % 100 = 0"), v, k, "vec_id", "vec_id", "embedding")  # the stated query set


@query("R08_dense_topk", f"WITH {DENSE} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dr WHERE rank <= 50")
def dense_topk(spark, sf_dir):
    return near(spark, sf_dir, 50).select("qid", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("R08_vector_index")
def vector_file(spark, sf_dir):
    """The approximate form: cells and quantised residuals written as files, of which a query reads the nearest; ranked by whole vectors."""
    v, out = table(spark, sf_dir, "embeddings"), landed.folder(spark)
    model = vector_index.fit(v, "vec_id", "embedding", cells=32)
    ix = vector_index.build(v, model, "vec_id", "embedding", out)
    asked = v.where("vec_id % 100 = 0")  # the stated query set
    got = vector_index.search(asked, ix, model, v, 50, query="vec_id", id="vec_id", column="embedding", probes=26)
    return got.select("qid", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("R09_masked_dense", f"WITH {DENSE}, o AS (SELECT dr.*, label FROM dr JOIN embeddings e ON e.vec_id = dr.doc_id WHERE rank <= 150), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) nr FROM o WHERE label < 5) SELECT qid, doc_id, CAST(nr AS INT) AS rank FROM m WHERE nr <= 50")
def masked_dense(spark, sf_dir):
    """Three times as many as asked for, then the mask, then the first 50."""
    labels = table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc"))
    kept = near(spark, sf_dir, 150).join(labels, "doc", "left_semi")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return kept.withColumn("nr", n).where("nr <= 50").select("qid", F.col("doc").alias("doc_id"), F.col("nr").alias("rank"))


MEANS = "m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) x FROM (SELECT label, unnest(embedding) x, unnest(range(len(embedding))) i FROM embeddings) GROUP BY ALL), mv AS (SELECT label, list(x ORDER BY i) v FROM m GROUP BY label)"


@query("A08_mean_vectors", f"WITH {MEANS} SELECT CAST(label AS INT) AS label, round(list_sum(v), 6) AS total, round(v[1], 6) AS first FROM mv")
def mean_vectors(spark, sf_dir):
    m = index.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("vector", 1), 6).alias("first"))


@query("R10_pooled_code_vectors", f"WITH {MEANS}, {VQ}, s AS (SELECT qid, label, list_cosine_similarity(CAST(qe AS DOUBLE[]), v) score FROM q, mv), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, label) rank FROM s) SELECT qid, CAST(label AS BIGINT) AS label, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def pooled(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    codes = index.mean_vectors(v, "label", "embedding").withColumnRenamed("vector", "embedding")
    got = retrieve.dense(v.where("vec_id % 100 = 0"), codes, 5, "vec_id", "label", "embedding")
    return got.select("qid", F.col("doc").alias("label"), F.round("score", 6).alias("score"), "rank")


@query("R13_filtered_dense", f"WITH {VQ}, s AS (SELECT qid, vec_id doc_id, list_inner_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[]))) * sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) score FROM q, embeddings WHERE label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) rank FROM s) SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def filtered_dense(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieve.dense(v.where("vec_id % 100 = 0"), v.where("label = 3"), 10, "vec_id", "vec_id", "embedding").select("qid", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


# Two systems over the codes (sources): the sparse one over documents, and a plain one by item and length.
TWO = f"""WITH {SCORED},
a0 AS (SELECT qid, source code, greatest(0, max(score)) score FROM s JOIN documents USING (doc_id) GROUP BY ALL),
b0 AS (SELECT qid, source code, count(*) * 1.0 / (1 + max(abs(dl - 100))) score FROM s JOIN documents USING (doc_id) JOIN stats USING (doc_id) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, code) rank FROM a0),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, code) rank FROM b0)"""
TOP5 = "SELECT qid, code, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, code) rank FROM {0}) WHERE rank <= 5"


def two(spark, sf_dir):
    s = summed(spark, sf_dir, "source").withColumnRenamed("key", "code")
    off = F.greatest(F.abs(F.col("shortest") - 100), F.abs(F.col("longest") - 100))
    return s.select("qid", "code", F.col("best").alias("score")), s.select("qid", "code", (F.col("n") * 1.0 / (1 + off)).cast("double").alias("score"))


def ranked(x, k=1 << 30):
    return retrieve.top(x, k, "code")


def five(x):
    return x.select("qid", "code", F.round("score", 6).alias("score"), "rank")


@query("A02_max_rollup", TWO + " SELECT qid, code, round(score, 6) AS score FROM a0")
def max_rollup(spark, sf_dir):
    return two(spark, sf_dir)[0].select("qid", "code", F.round("score", 6).alias("score"))


@query("P01_min_max", TWO + " SELECT qid, code, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT *, min(score) OVER (PARTITION BY qid) lo, max(score) OVER (PARTITION BY qid) hi FROM a0)")
def min_max(spark, sf_dir):
    return two(spark, sf_dir)[0].select("qid", "code", F.round(fusion.min_max("score"), 6).alias("scaled"))


SCALED = ", na AS (SELECT qid, code, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END x FROM a0 WINDOW w AS (PARTITION BY qid)), nb AS (SELECT qid, code, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END x FROM b0 WINDOW w AS (PARTITION BY qid))"


@query("P02_fuse", TWO + SCALED + ", f AS (SELECT qid, code, (0.5 * coalesce(na.x, 0) + 0.5 * coalesce(nb.x, 0)) * CASE WHEN code = 'src1' THEN 0.75 ELSE 1.0 END score FROM na FULL JOIN nb USING (qid, code) WHERE code <> 'src0') " + TOP5.format("f"))
def fuse(spark, sf_dir):
    a, b = two(spark, sf_dir)
    excluded = spark.createDataFrame([("src0",)], "code string")
    multipliers = a.where("code = 'src1'").select("qid", "code").union(b.where("code = 'src1'").select("qid", "code")).distinct().withColumn("multiplier", F.lit(0.75))
    return five(fusion.fuse([(a, 0.5), (b, 0.5)], 5, excluded, multipliers))


@query("R11_rrf", TWO + ", f AS (SELECT qid, code, sum(1.0 / (60 + rank)) score FROM (SELECT qid, code, rank FROM a UNION ALL SELECT qid, code, rank FROM b) GROUP BY ALL) " + TOP5.format("f").replace("rank <= 5", "rank <= 30"))
def rrf(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return five(retrieve.rrf([ranked(a), ranked(b)], 30, key="code"))


@query("P06_weighted_rrf", TWO + ", f AS (SELECT qid, code, 0.6 / (60 + coalesce(a.rank, na + 1)) + 0.4 / (60 + coalesce(b.rank, nb + 1)) score FROM (SELECT * FROM a WHERE rank <= 10) a FULL JOIN (SELECT * FROM b WHERE rank <= 5) b USING (qid, code) LEFT JOIN (SELECT qid, max(rank) na FROM a WHERE rank <= 10 GROUP BY 1) USING (qid) LEFT JOIN (SELECT qid, max(rank) nb FROM b WHERE rank <= 5 GROUP BY 1) USING (qid)) " + TOP5.format("f"))
def weighted(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return five(fusion.weighted_rrf(ranked(a, 10), ranked(b, 5), 0.6, 0.4, 5))


@query("P07_rrf_ensemble", TWO + ", f AS (SELECT qid, code, sum(1.0 / (60 + rank)) score FROM (SELECT qid, code, rank FROM a WHERE rank <= 5 UNION ALL SELECT qid, code, rank FROM b WHERE rank <= 5) GROUP BY ALL) " + TOP5.format("f"))
def rrf_ensemble(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return five(retrieve.rrf([ranked(a, 5), ranked(b, 5)], 5, key="code"))


@query("P08_borda", TWO + ", f AS (SELECT qid, code, CAST(sum(greatest(0, 6 - rank)) AS DOUBLE) score FROM (SELECT qid, code, rank FROM a WHERE rank <= 5 UNION ALL SELECT qid, code, rank FROM b WHERE rank <= 5) GROUP BY ALL) " + TOP5.format("f"))
def borda(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return five(fusion.borda([ranked(a, 5), ranked(b, 5)], 5))


ROUTE = ", h AS (SELECT qid, CASE WHEN b.code IN ('src3', 'src7') THEN b.code ELSE coalesce(a.code, b.code) END code FROM (SELECT * FROM a WHERE rank = 1) a FULL JOIN (SELECT * FROM b WHERE rank = 1) b USING (qid)), u AS (SELECT qid, code, sum(1.0 / (60 + rank)) score FROM (SELECT qid, code, rank FROM a WHERE rank <= 5 UNION ALL SELECT qid, code, rank FROM b WHERE rank <= 5) GROUP BY ALL), rest AS (SELECT u.qid, u.code, row_number() OVER (PARTITION BY u.qid ORDER BY round(u.score, 9) DESC, u.code) + 1 rank FROM u ANTI JOIN h USING (qid, code)), route AS (SELECT qid, code, 1 rank FROM h UNION ALL SELECT * FROM rest WHERE rank <= 5)"


@query("P10_router", TWO + ROUTE + " SELECT qid, code, CAST(rank AS INT) AS rank FROM route")
def router(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return fusion.routed(ranked(a, 5), ranked(b, 5), ["src3", "src7"], 5)


@query("P12_disagreement", TWO + " SELECT qid, a.code AS first_a, b.code AS first_b, a.code <> b.code AS differ FROM a JOIN b USING (qid) WHERE a.rank = 1 AND b.rank = 1")
def disagreement(spark, sf_dir):
    a, b = two(spark, sf_dir)
    first = lambda x, n: ranked(x, 1).select("qid", F.col("code").alias(n))
    return first(a, "first_a").join(first(b, "first_b"), "qid").withColumn("differ", F.col("first_a") != F.col("first_b"))


#: A judge that names the second list's first for every other query, and nothing for a fifth.
JUDGED = ", j AS (SELECT qid, a.code fa, b.code fb, CASE WHEN qid % 5 = 0 THEN NULL WHEN qid % 2 = 0 THEN b.code ELSE a.code END choice FROM (SELECT * FROM a WHERE rank = 1) a FULL JOIN (SELECT * FROM b WHERE rank = 1) b USING (qid)), h AS (SELECT qid, CASE WHEN fa <> fb AND choice IS NOT NULL THEN choice ELSE coalesce(fa, fb) END code FROM j), "


@query("P12_judged", TWO + JUDGED + ROUTE.split("), ", 1)[1] + " SELECT qid, code, CAST(rank AS INT) AS rank FROM route")
def judged(spark, sf_dir):
    """Two systems; where their first places differ a judge's answer is read for one of the two (D19) and comes first, the rest by rank fusion."""
    a, b = (ranked(x, 5) for x in two(spark, sf_dir))
    first = lambda x, n: x.where("rank = 1").select("qid", F.col("code").alias(n))
    pairs = first(a, "fa").join(first(b, "fb"), "qid").where("fa <> fb")
    said = F.when(F.col("qid") % 5 == 0, "no idea").when(F.col("qid") % 2 == 0, F.concat(F.lit("CHOICE: "), "fb", F.lit("."))).otherwise(F.concat(F.lit("choice:"), "fa"))
    return fusion.judged(a, b, pairs.select("qid", text.choice(said, F.col("fa"), F.col("fb")).alias("choice")), 5)


@query("P05_prior_injection", TWO + ", pr AS (SELECT source code, count(*) * 1.0 / (SELECT count(*) FROM documents) prior FROM documents GROUP BY 1), f AS (SELECT qid, code, score + 0.15 * coalesce(prior, 0) score FROM (SELECT * FROM a WHERE rank <= 10) LEFT JOIN pr USING (code)) " + TOP5.format("f"))
def prior_injection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a, _ = two(spark, sf_dir)
    whole = docs.agg(F.count(F.lit(1)).alias("all"))
    prior = docs.groupBy(F.col("source").alias("code")).agg(F.count(F.lit(1)).alias("c")).crossJoin(whole).select("code", (F.col("c") * 1.0 / F.col("all")).alias("prior"))  # one row
    moved = ranked(a, 10).drop("rank").join(prior, "code", "left").select("qid", "code", (F.col("score") + 0.15 * F.coalesce("prior", F.lit(0.0))).alias("score"))
    return five(ranked(moved, 5))


SLOTS = ", m AS (SELECT qid, code, rank, code IN ('src1', 'src4', 'src9') AS member, length(code) * 10.0 - rank * 0.5 + CAST(substr(code, 4) AS INT) new_score FROM a WHERE rank <= 5), t AS (SELECT *, row_number() OVER (PARTITION BY qid, member ORDER BY rank) slot, row_number() OVER (PARTITION BY qid, member ORDER BY round(new_score, 9) DESC, rank) turn FROM m)"


@query("P13_slot_rerank", TWO + SLOTS + " SELECT x.qid, x.code, CAST(CASE WHEN x.member THEN y.rank ELSE x.rank END AS INT) AS rank FROM t x JOIN t y ON x.qid = y.qid AND x.member = y.member AND x.turn = y.slot WHERE x.member UNION ALL SELECT qid, code, CAST(rank AS INT) FROM t WHERE NOT member")
def slot_rerank(spark, sf_dir):
    a, _ = two(spark, sf_dir)
    x = ranked(a, 5).withColumns({"member": F.col("code").isin("src1", "src4", "src9"), "new_score": F.length("code") * 10.0 - F.col("rank") * 0.5 + F.substring("code", 4, 9).cast("int")})
    return fusion.slot_rerank(x)


# Every hundredth document is a project: its text and its vector ask, and its features are drawn by its id.
FEATURES = f"""SELECT doc_id AS qid, CASE CAST(doc_id / 100 AS INT) % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'small' END AS scale, {pick([*keywords.SCOPES, '06-construction'], 'CAST(doc_id / 100 AS INT)')} AS scope,
  {pick([*keywords.TECHNOLOGIES], 'CAST(doc_id / 100 AS INT)')} AS technology, split(concat({pick([*keywords.GASES], 'CAST(doc_id / 100 AS INT)')}, ',CO2'), ',') AS gases FROM documents WHERE doc_id % 100 = 0"""
ALL_WORDS = ", ".join(f"('{d}', '{k}', '{w}')" for d, words in (("scope", keywords.SCOPES), ("technology", keywords.TECHNOLOGIES), ("ghg", keywords.GASES)) for k, v in words.items() for w in v)


@query(
    "P17_fusion_only",
    f"WITH {SCORED}, {DENSE}".replace("item_id qid", "doc_id qid").replace("FROM benchmark", "FROM documents WHERE doc_id % 100 = 0")
    + f""", c AS ({CANDIDATES}), p AS ({FEATURES}), sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) rank FROM s),
a0 AS (SELECT qid, code, greatest(0, max(score)) score FROM sr JOIN c USING (doc_id) WHERE rank <= 50 GROUP BY ALL), b0 AS (SELECT qid, code, greatest(0, max(score)) score FROM dr JOIN c USING (doc_id) WHERE rank <= 50 GROUP BY ALL)"""
    + SCALED
    + f""", facts AS (SELECT DISTINCT code, dimension, key FROM c, (VALUES {ALL_WORDS}) k(dimension, key, word) WHERE contains(lower(text), lower(word))), small AS (SELECT DISTINCT code FROM c WHERE contains(lower(text), 'small-scale')),
f AS (SELECT qid, code, 0.5 * coalesce(na.x, 0) + 0.5 * coalesce(nb.x, 0) score FROM na FULL JOIN nb USING (qid, code)),
g AS (SELECT f.*, CAST(coalesce(CASE scale WHEN 'small' THEN code LIKE 'AMS-%' OR code IN (FROM small) WHEN 'large' THEN code NOT LIKE 'AMS-%' END, FALSE) AS INT) + CAST((code, 'scope', scope) IN (FROM facts) AS INT) + CAST((code, 'technology', technology) IN (FROM facts) AS INT)
  + CAST((code, 'ghg', gases[1]) IN (FROM facts) OR (code, 'ghg', gases[2]) IN (FROM facts) AS INT) AS n FROM f LEFT JOIN p USING (qid) WHERE NOT coalesce(scale = 'large' AND code LIKE 'AMS-%', FALSE))
SELECT qid, code, round(score, 6) AS score, CAST(rank AS INT) AS rank, CAST(coalesce(n, 0) AS BIGINT) AS match_count FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, code) rank FROM g) WHERE rank <= 5""",
)
def fusion_only(spark, sf_dir):
    """The flagship: the best 50 clauses of the sparse and of the dense channel, rolled up by code and fused, less what the project's scale excludes."""
    docs, texts = table(spark, sf_dir, "documents"), rows(spark, sf_dir, CANDIDATES).select(F.col("doc_id").alias("doc"), "code", "text")
    keys = texts.select("doc", "code")
    best = retrieve.bm25_top(docs.where("doc_id % 100 = 0"), docs, index.build(docs, "doc_id", "text"), "doc_id", "doc_id", "text", 50)
    sparse, dense = (landed.kept(fusion.rolled_up(x, keys)) for x in (best, near(spark, sf_dir, 50)))  # read by candidates and by both channels
    fused = fusion.fusion_only(sparse, dense, rows(spark, sf_dir, FEATURES), texts.select("code", "text"))
    return fused.select("qid", "code", F.round("score", 6).alias("score"), "rank", "match_count")


LINES = "SELECT conv_id, turn, concat(role, ': ', substr(text, 1, 120)) AS line FROM conversations"


@query("A18_budget_block", f"SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS block, CAST(count(*) AS BIGINT) AS n_lines FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn) used FROM ({LINES})) WHERE used <= 300 GROUP BY conv_id")
def budget_block(spark, sf_dir):
    return fusion.budgeted(rows(spark, sf_dir, LINES), "conv_id", "turn", "line", 300)


@query("M01_gt_rank", TWO + ", l AS (SELECT qid, list(code ORDER BY rank) codes FROM a WHERE rank <= 5 GROUP BY qid) SELECT item_id AS qid, CAST(nullif(coalesce(list_position(codes, concat('src', CAST(item_id % 20 AS STRING))), 0), 0) AS INT) AS gt_rank FROM benchmark LEFT JOIN l ON qid = item_id")
def gt_rank(spark, sf_dir):
    a, _ = two(spark, sf_dir)
    lists = ranked(a, 5).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("truth"))
    return items.join(lists, "qid", "left").select("qid", F.nullif(F.coalesce(F.array_position("codes", F.col("truth")).cast("int"), F.lit(0)), F.lit(0)).alias("gt_rank"))
