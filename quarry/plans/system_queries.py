"""Queries of whole systems: recommenders, ensembles, reports, nested records, files, incremental runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.operators import catalogue, evaluate, filters, fusion, index, retrieve
from quarry.sources import landed
from quarry.streaming import incremental

from . import recommend
from .code_queries import KEEP, LISTED, VERSIONS
from .code_queries import PROJECTS as SEGMENTS
from .registry import CODES, query, rows, table
from .retrieval_queries import ROUTE, SCORED, TWO, ranked, two

TRUTH = "concat('src', CAST(qid % 20 AS STRING))"


def truth():
    return F.concat(F.lit("src"), F.col("qid") % 20)


def _inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("code"), "text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), docs


def _echo(prompts):
    """A stand-in model: names two candidates of the prompt in reverse, one that is none, and one twice."""
    out = []
    for p in prompts:
        lines = [x.split(" ", 1)[1] for x in p.split("\n") if x[:2].strip(".").isdigit() and " " in x][:2]
        out.append('Sure: {"codes": ["nope", ' + ", ".join(f'"{x}"' for x in [*lines[::-1], *lines[:1]]) + "]}")
    return out


@query("P18_recommender", TWO.replace("b0 AS", "b00 AS", 1).replace("FROM b0)", "FROM b00)") + ", x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, code) k FROM (SELECT qid, code, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END * 0.5 sc FROM a0 WINDOW w AS (PARTITION BY qid))) SELECT qid, code, CAST(CASE k WHEN 2 THEN 1 ELSE 2 END AS INT) AS rank, round(CASE k WHEN 2 THEN 1.0 / 2 ELSE 1.0 / 3 END, 6) AS score FROM x WHERE k <= 2 AND qid IN (SELECT qid FROM x WHERE k = 2) UNION ALL SELECT qid, code, 1, round(1.0 / 2, 6) FROM x WHERE k = 1 AND qid NOT IN (SELECT qid FROM x WHERE k = 2)")
def recommender(spark, sf_dir):
    """A masked prompt, a stand-in model's noisy answer, validation and places."""
    q, d = _inputs(spark, sf_dir)
    return recommend.recommend(q, d, recommend.SYSTEMS["v2"], transport=_echo).select("qid", "code", "rank", F.round("score", 6).alias("score"))


@query("P20_fallback")
def fallback(spark, sf_dir):
    """A model that fails: the fused order stands (P20)."""

    def broken(_):
        raise OSError("no model here")

    q, d = _inputs(spark, sf_dir)
    return recommend.recommend(q, d, recommend.SYSTEMS["naive_rag"], transport=broken).select("qid", "code", "rank", F.round("score", 6).alias("score"))


@query("P21_prompt_block")
def prompt_block(spark, sf_dir):
    q, d = _inputs(spark, sf_dir)
    c = recommend.SYSTEMS["v1"]
    return recommend.prompts(q, recommend.candidates(q, d, c), c).select("qid", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


@query("L02_systems")
def systems(spark, sf_dir):
    """Every named system without a model, in one table."""
    q, d = _inputs(spark, sf_dir)
    out = None
    for name, config in recommend.SYSTEMS.items():
        one = recommend.recommend(q, d, config).select(F.lit(name).alias("system"), "qid", "code", "rank")
        out = one if out is None else out.union(one)
    return out


def lists(x, k=5):
    return ranked(x, k).select("qid", "code", "rank")


EVAL = "SELECT '{0}' AS system, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM (SELECT item_id qid FROM benchmark) q LEFT JOIN (SELECT qid, rank FROM {1} WHERE rank <= 5 AND code = " + TRUTH + ") USING (qid)"
ENSEMBLE = ", e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, code) rank FROM (SELECT qid, code, sum(1.0 / (60 + rank)) score FROM (SELECT qid, code, rank FROM a WHERE rank <= 5 UNION ALL SELECT qid, code, rank FROM b WHERE rank <= 5) GROUP BY ALL))"


@query("P09_ensemble_metrics", TWO + ENSEMBLE + " " + " UNION ALL ".join(EVAL.format(n, n) for n in "abe"))
def ensemble_metrics(spark, sf_dir):
    """Two systems and their rank fusion, measured."""
    a, b = two(spark, sf_dir)
    a, b = ranked(a, 5), ranked(b, 5)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    out = None
    for name, x in (("a", a), ("b", b), ("e", retrieve.rrf([a, b], 5, key="code"))):
        hit = items.join(x.where(F.col("code") == truth()).select("qid", "rank"), "qid", "left")
        one = hit.agg(*stats.metrics(F.col("rank"))).select(F.lit(name).alias("system"), "*")
        out = one if out is None else out.union(one)
    return out


#: Versions of the codes and a date of each query, null for a tenth.
CODE_VERSIONS = f"SELECT concat('src', CAST(code - 1 AS STRING)) AS code, ef, et, status FROM ({VERSIONS}) WHERE code BETWEEN 1 AND 20"
DAY = "CASE WHEN qid % 10 > 0 THEN DATE '1997-06-01' + CAST(qid % 900 AS INT) END"
FILTERED = f", v AS (SELECT code, max(CAST(status = 'Withdrawn' AS INT)) AS w, max(coalesce(et, DATE '9999-12-31')) AS final FROM ({CODE_VERSIONS}) GROUP BY code)" + "".join(
    f", f{x} AS (SELECT qid, {x}.code, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM {x} LEFT JOIN v ON v.code = {x}.code WHERE rank <= 5 AND ({DAY} IS NULL OR NOT (coalesce(w = 1, FALSE) OR coalesce(final < {DAY}, FALSE))))" for x in "ab"
)


@query("P11_dated_router", TWO + FILTERED + ROUTE.replace("FROM a WHERE", "FROM fa WHERE").replace("FROM b WHERE", "FROM fb WHERE") + " SELECT qid, code, CAST(rank AS INT) AS rank FROM route UNION ALL SELECT qid, code, CAST(rank AS INT) FROM a WHERE rank <= 5 AND qid NOT IN (SELECT qid FROM route) UNION ALL SELECT qid, code, CAST(rank AS INT) FROM b WHERE rank <= 5 AND qid NOT IN (SELECT qid FROM route) AND qid NOT IN (SELECT qid FROM a)")
def dated_router(spark, sf_dir):
    """The router over lists of five without the codes that are invalid at the query's date (P11); a query without date keeps all, and one that is left no code its unfiltered five."""
    versions, order = rows(spark, sf_dir, CODE_VERSIONS), Window.partitionBy("qid").orderBy("rank")

    def filtered(x):
        dated = ranked(x, 5).select("qid", "code", "rank", F.expr(DAY).alias("d"))
        return filters.invalid_at(dated, versions).where("NOT invalid").select("qid", "code", F.row_number().over(order).alias("rank"))

    a, b = two(spark, sf_dir)
    return fusion.or_unrouted(fusion.routed(filtered(a), filtered(b), ["src3", "src7"], 5), ranked(a, 5), ranked(b, 5), 5)


@query("M07_model_table", f"{TWO} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(x.code = t AND y.code <> t) AS BIGINT) AS b, CAST(count_if(x.code <> t AND y.code = t) AS BIGINT) AS c FROM (SELECT *, {TRUTH} t FROM a WHERE rank = 1) x JOIN (SELECT * FROM b WHERE rank = 1) y USING (qid)")
def model_table(spark, sf_dir):
    """Paired comparison of the systems' first places."""
    a, b = two(spark, sf_dir)
    hit = lambda x: ranked(x, 1).select("qid", (F.col("code") == truth()).alias("hit"))
    return evaluate.paired(hit(a), hit(b)).select("n", "b", "c")


#: A project for each order, and the code that it uses.
USED = f"SELECT o.o_orderpriority AS project, c.code FROM orders o JOIN ({CODES}) c ON c.p_partkey = o.o_orderkey % 200 + 1"


@query(
    "M12_prefilter",
    f"""WITH p AS ({SEGMENTS}), f AS (SELECT *, {KEEP} AS a, NOT (scale = 'large' AND code LIKE 'AMS-%') AS b FROM p, ({LISTED})), z AS (SELECT project, count(*) n_all, count_if(a) n_a, count_if(a AND b) n_b FROM f GROUP BY project)
    SELECT p.registry, CAST(count(*) AS BIGINT) AS n, CAST(count_if(f.a AND f.b) AS BIGINT) AS passed, round(avg(n_a), 6) AS mean_registry, round(avg(n_b), 6) AS mean_scale, CAST(min(n_b) AS BIGINT) AS least, round(avg(n_b * 1.0 / n_all), 6) AS retention
    FROM ({USED}) u JOIN p USING (project) JOIN z USING (project) JOIN f ON f.project = u.project AND f.code = u.code GROUP BY p.registry""",
)
def prefilter(spark, sf_dir):
    """Projects whose code the registry and scale filters let pass, and how much of the label space they leave.

    Spaces are counted once for each kind of project; projects meet their own code only.
    """
    projects, space = rows(spark, sf_dir, SEGMENTS), rows(spark, sf_dir, LISTED)
    sizes = filters.allow_list(projects, space)
    own = rows(spark, sf_dir, USED).groupBy("project", "code").agg(F.count(F.lit(1)).alias("k")).join(projects, "project").join(space, "code").join(sizes, "project")
    passes = filters.keeps(F.col("registry"), F.col("code"), F.col("standard")) & filters.scale_fits(F.col("scale"), F.col("code"))
    mean = lambda c: F.round(F.sum(c * F.col("k")) / F.sum("k"), 6)
    return own.groupBy("registry").agg(
        F.sum("k").alias("n"), F.sum(F.when(passes, F.col("k")).otherwise(0)).alias("passed"), mean(F.col("n_registry")).alias("mean_registry"),
        mean(F.col("n_scale")).alias("mean_scale"), F.min("n_scale").alias("least"), mean(F.col("n_scale") / F.col("n_all")).alias("retention"),
    )


WEIGHTS = [("full", 0.4, 0.4, 0.2), ("third_off", 0.5, 0.5, 0.0)]
SCALED = ", ".join(f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-9 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}" for c in "xyz")


@query(
    "M22_ablation",
    TWO + f", j AS (SELECT qid, code, a0.score AS x, b0.score AS y, n * 1.0 AS z FROM a0 JOIN b0 USING (qid, code) JOIN (SELECT source AS code, count(*) n FROM documents GROUP BY 1) USING (code)), m AS (SELECT qid, code, {SCALED} FROM j WINDOW w AS (PARTITION BY qid)), k AS (SELECT * FROM (VALUES " + ", ".join(map(str, WEIGHTS)) + f") k(config, wx, wy, wz)), f AS (SELECT config, qid, code, row_number() OVER (PARTITION BY config, qid ORDER BY round(wx * x + wy * y + wz * z, 9) DESC, code) AS rank FROM m, k) SELECT config, CAST(count(*) AS BIGINT) AS n, CAST(count_if(rank = 1) AS BIGINT) AS top1, CAST(count_if(rank <= 5) AS BIGINT) AS top5, round(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM f WHERE code = {TRUTH} GROUP BY config",
)
def ablation(spark, sf_dir):
    """Weighted fusion of three signals, and the same with the third's weight at zero."""
    a, b = two(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("code")).agg(F.count(F.lit(1)).cast("double").alias("z"))
    j = a.select("qid", "code", F.col("score").alias("x")).join(b.select("qid", "code", F.col("score").alias("y")), ["qid", "code"]).join(docs, "code")
    m = j.select("qid", "code", *(fusion.min_max(c).alias(c) for c in "xyz"))
    weights = spark.createDataFrame(WEIGHTS, "config string, wx double, wy double, wz double")
    f = m.crossJoin(F.broadcast(weights)).withColumn("key", F.struct("config", "qid")).withColumn("score", sum(F.col(f"w{c}") * F.col(c) for c in "xyz"))  # two rows
    rank = F.col("rank")
    r = retrieve.top(f, 1 << 30, "code", "key").where(F.col("code") == truth())
    return r.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.count_if(rank == 1).alias("top1"), F.count_if(rank <= 5).alias("top5"), F.round(F.avg(F.when(rank <= 5, 1.0 / rank).otherwise(0.0)), 6).alias("mrr"))


NESTED = """SELECT p_brand AS code, array_agg(named_struct('name', p_type, 'primary', p_size % 10 = 0)) AS standards,
  array_agg(named_struct('version', CAST(p_size AS STRING), 'ef', CAST(p_partkey AS STRING), 'url', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END)) AS versions,
  array_agg(named_struct('code', p_type, 'version', CAST(p_size AS STRING))) AS tools FROM part GROUP BY p_brand"""


@query("Q06_catalog_normalize", "SELECT p_brand AS code, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS all_standards, arg_max(CAST(p_size AS STRING), CAST(p_partkey AS STRING)) FILTER (WHERE p_partkey % 3 <> 0) AS latest_version, CAST(count(DISTINCT (p_type, p_size)) AS BIGINT) AS n_tools FROM part GROUP BY 1")
def catalog_normalize(spark, sf_dir):
    c = catalogue.catalog(rows(spark, sf_dir, NESTED))
    return c.select("code", F.array_join("all_standards", ",").alias("all_standards"), "latest_version", F.col("n_tools").cast("long").alias("n_tools"))


PROJECTS = "SELECT o_custkey AS gid, CAST(min(o_orderdate) AS STRING) AS started, CAST(max(o_orderdate) AS STRING) AS ended, array_sort(array_agg(named_struct('url', o_orderpriority, 'key', o_orderkey))) AS documents FROM orders GROUP BY o_custkey"


@query("Q09_project_normalize", "SELECT o_custkey AS gid, min(o_orderpriority) AS primary_url, substr(CAST(min(o_orderdate) AS STRING), 1, 10) AS started, CAST(least(count(*) - 1, 30) AS BIGINT) AS n_other FROM orders GROUP BY 1")
def project_normalize(spark, sf_dir):
    p = catalogue.projects(rows(spark, sf_dir, PROJECTS))
    return p.select("gid", "primary_url", "started", F.size("other_urls").cast("long").alias("n_other"))


@query("J03_paired_intersection", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def paired_intersection(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    keys = lambda f: l.where(F.col("l_returnflag") == f).select("l_orderkey").distinct()
    return keys("A").join(keys("R"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("J04_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 30)")
def semi_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("J12_keyed_vectors", "SELECT vec_id, lang FROM embeddings JOIN documents ON vec_id = doc_id")
def keyed_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return table(spark, sf_dir, "embeddings").join(d, "vec_id").select("vec_id", "lang")


@query("X05_argsort", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rank FROM supplier ORDER BY rank LIMIT 20")
def argsort(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    return t.select("s_suppkey", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rank"))


@query("R14_pca")
def pca(spark, sf_dir):
    """Vectors in eight dimensions by a model that was fitted on a seeded sample, saved and loaded (R14, S07): their norms."""
    from pyspark.ml import PipelineModel

    v, out = table(spark, sf_dir, "embeddings"), f"{_landed(spark, sf_dir)}/pca"
    index.fit_pca(v, "vec_id", "embedding", 8).write().overwrite().save(out)
    reduced = index.reduced(v, PipelineModel.load(out), "embedding")
    return reduced.select("vec_id", F.size("reduced").alias("dims"), F.round(F.sqrt(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@query("R14_explained_variance")
def explained_variance(spark, sf_dir):
    """Share of the sample's variance that each component explains."""
    model = index.fit_pca(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(model.stages[-1].explainedVariance)], "component int, variance double")


@query("R12_raw_channels", TWO + " SELECT 'a' AS channel, qid, code, CAST(rank AS INT) AS rank FROM a WHERE rank <= 10 UNION ALL SELECT 'b', qid, code, CAST(rank AS INT) FROM b WHERE rank <= 10")
def raw_channels(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return lists(a, 10).select(F.lit("a").alias("channel"), "*").union(lists(b, 10).select(F.lit("b").alias("channel"), "*"))


@query("J07_scoring_join", TWO + " SELECT CAST(count(*) AS BIGINT) AS pairs FROM s")
def scoring_join(spark, sf_dir):
    q, d = _inputs(spark, sf_dir)
    return retrieve.bm25_by_key(q, d, index.build(d, "doc", "text"), "qid", "doc", "text", "code").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def _landed(spark, sf_dir):
    return landed.folder(spark)


@query("S01_json_scan", "SELECT doc_id, lang FROM documents")
def json_scan(spark, sf_dir):
    """Documents written as JSON lines and scanned with a stated schema."""
    out = f"{_landed(spark, sf_dir)}/json"
    table(spark, sf_dir, "documents").select("doc_id", "lang").write.mode("overwrite").json(out)
    return spark.read.schema("doc_id long, lang string").option("recursiveFileLookup", True).json(out)


@query("S05_parquet_sink", "SELECT o_orderpriority AS run_id, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def parquet_sink(spark, sf_dir):
    """Runs as partitions, read with partition pruning."""
    out = f"{_landed(spark, sf_dir)}/runs"
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("run_id")).write.mode("overwrite").partitionBy("run_id").parquet(out)
    return spark.read.parquet(out).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


PATHS = "SELECT concat('/r/sys', CAST(p_size % 7 AS STRING), '-n', CAST(p_partkey AS STRING), '.json') AS path FROM part"


@query("S10_latest_artifact", f"SELECT regexp_extract(path, '/([^/]*)-n', 1) AS slug, CAST(max(CAST(regexp_extract(path, '-n(\\d+)', 1) AS BIGINT)) AS BIGINT) AS n FROM ({PATHS}) GROUP BY 1")
def latest_artifact(spark, sf_dir):
    """Largest n of each slug; the newest snapshot is the same by name."""
    return landed.latest(rows(spark, sf_dir, PATHS)).select("slug", "n")


@query("S32_report", "SELECT '| r_name | n |' AS value UNION ALL SELECT '|---|---|' UNION ALL SELECT concat('| ', r_name, ' | ', count(*), ' |') FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def report(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    return landed.report(n, ["r_name", "n"])


MANIFEST = "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN array(c_custkey, c_custkey + 1) END AS globalIds, CASE WHEN c_custkey % 2 = 1 THEN map('a', array(c_custkey), 'b', array(c_custkey * 2)) END AS by_class_globalIds FROM customer"


@query("S33_manifest_variants", "SELECT unnest(CASE WHEN c_custkey % 2 = 0 THEN [c_custkey, c_custkey + 1] ELSE [c_custkey, c_custkey * 2] END) AS gid FROM customer")
def manifest_variants(spark, sf_dir):
    return landed.manifest_ids(rows(spark, sf_dir, MANIFEST))


@query("S34_text_source", "SELECT doc_id AS gid, md5(text) AS digest FROM documents WHERE lang = 'en'")
def text_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gid"), F.when(F.col("lang") == "en", F.col("text")).alias("rich"), F.col("text").alias("clean"))
    return landed.text_source(d, "rich").select("gid", F.md5("text").alias("digest"))


STATUS = "SELECT o_orderkey, o_orderkey % 6 = 0 AS present, CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS status FROM orders"


@query("S20_status_tally", f"SELECT CASE WHEN present THEN 'skip_exists' WHEN status = 200 THEN 'ok' WHEN status = 403 THEN 'fail_403' WHEN status = 404 THEN 'fail_404' ELSE 'fail_other' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM ({STATUS}) GROUP BY 1")
def status_tally(spark, sf_dir):
    return rows(spark, sf_dir, STATUS).groupBy(landed.fetched(F.col("present"), F.col("status")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("L07_incremental_index")
def incremental_index(spark, sf_dir):
    """Postings appended by a file stream until it has caught up; the rows that the sink then holds."""
    base = _landed(spark, sf_dir)
    out = f"{base}/postings"
    schema = table(spark, sf_dir, "documents").schema
    src = f"{base}/stream-in"
    table(spark, sf_dir, "documents").write.mode("overwrite").parquet(src)
    incremental.catch_up(spark, src, schema.simpleString()[7:-1].replace(":", " "), f"{out}/rows", f"{out}/checkpoint", "doc_id", "text")
    return spark.read.parquet(f"{out}/rows").select(F.col("doc").alias("doc_id"), "dl", F.size("terms").alias("n_terms"))


@query(
    "L07_index_statistics",
    f"WITH {SCORED} SELECT term, CAST(df AS BIGINT) AS df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf, CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, (SELECT CAST(sum(tf) AS BIGINT) FROM post p WHERE p.term = terms.term) AS n_all FROM terms, tot",
)
def index_statistics(spark, sf_dir):
    """Statistics of an index that three deliveries of documents were appended to, each by a run of its own."""
    base, docs = landed.folder(spark), table(spark, sf_dir, "documents")
    schema = docs.schema.simpleString()[7:-1].replace(":", " ")
    for k in range(3):
        docs.where(F.pmod("doc_id", F.lit(3)) == k).write.mode("append").parquet(f"{base}/in")
        incremental.catch_up_index(spark, f"{base}/in", schema, f"{base}/index", f"{base}/checkpoint", "doc_id", "text")
    ix = incremental.landed_index(spark, f"{base}/index")
    uses = ix.postings.groupBy("term").agg(F.sum("tf").alias("n_all"))
    return ix.terms.join(uses, "term").crossJoin(F.broadcast(ix.totals)).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"), "n_all")  # one row
