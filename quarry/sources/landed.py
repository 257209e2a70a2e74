"""Landed files: JSON, Parquet, binary files, manifests; snapshots and run results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A fresh folder that the engine may write to: in the one that spark.checkpoint.dir, or the context, names; a temporary one only for a local master."""
    base, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if base or held.isDefined():
        return f"{(base or held.get()).rstrip('/')}/landed-{uuid.uuid4().hex}"
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="landed-")


def kept(df: DataFrame) -> DataFrame:
    """df written to a fresh folder and read again, so that a small result of much work is made once."""
    path = f"{folder(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_tree(spark: SparkSession, folder: str, schema: str, glob: str = "*.body.json") -> DataFrame:
    """One row a JSON file under a folder tree, with its path (S01, S02, S03); the schema is stated, not inferred."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(folder)
    return df.withColumn("path", F.col("_metadata.file_path"))


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side table, or an empty one of the same schema where the file is absent."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.createDataFrame([], schema)


def write_run(predictions: DataFrame, folder: str, run_id: str) -> None:
    """A run's predictions as a partition of their own; a rerun replaces only itself."""
    predictions.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def write_result(predictions: DataFrame, folder: str, name: str, split: str, seed: int) -> str:
    """A run's predictions as JSON lines in ``{name}-{split}-n{rows}-seed{seed}.json`` (S09); gives the path."""
    path = f"{folder}/{name}-{split}-n{predictions.count()}-seed{seed}.json"
    predictions.write.mode("overwrite").json(path)
    return path


def save_manifest(entries: DataFrame, folder: str) -> None:
    """A manifest (S08): version, time (D04) and count, then an entry a line as a flow mapping, which YAML readers take.

    Manifests list documents or codes, so one file holds them.
    """
    stamp = F.date_format(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = entries.agg(F.count(F.lit(1)).alias("n")).select(
        F.posexplode(F.array(F.lit('version: "0.1"'), F.concat(F.lit('generated_at: "'), stamp, F.lit('"')), F.concat(F.lit("count: "), F.col("n")), F.when(F.col("n") > 0, "entries:").otherwise("entries: []"))).alias("at", "value")
    )
    body = entries.select(F.lit(4).alias("at"), F.concat(F.lit("- "), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value"))
    head.union(body).orderBy("at", "value").coalesce(1).select("value").write.mode("overwrite").text(folder)


def load_manifest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The entries of a manifest that save_manifest wrote."""
    line = spark.read.text(folder).where(F.col("value").startswith("- "))
    return line.select(F.from_json(F.expr("substr(value, 3)"), schema).alias("e")).select("e.*")


def latest(paths: DataFrame, path: str = "path") -> DataFrame:
    """The artifact of each slug with the largest n in ``{slug}-n{n}``."""
    name = F.element_at(F.split(path, "/"), -1)
    parsed = paths.select(F.regexp_extract(name, r"^(.*?)-n(\d+)", 1).alias("slug"), F.regexp_extract(name, r"-n(\d+)", 1).try_cast("long").alias("n"), path)
    return parsed.where("slug <> ''").groupBy("slug").agg(F.max_by(path, F.struct("n", path)).alias(path), F.max("n").alias("n"))


def newest(paths: DataFrame, name: str, path: str = "path") -> DataFrame:
    """(slug, path): of each slug, the first group of the pattern ``name``, the file whose name is last in order (S12); other files are left out."""
    file = F.element_at(F.split(path, "/"), -1)
    named = paths.where(file.rlike(name)).select(F.regexp_extract(file, name, 1).alias("slug"), file.alias("_file"), path)
    return named.groupBy("slug").agg(F.max(F.struct("_file", path))[path].alias(path))


def fetched(present: Column, status: Column) -> Column:
    """What came of a download (S20): a file that was there is skipped, 200 is ok, other answers fail by their number."""
    return F.when(present, "skip_exists").when(status == 200, "ok").when(status.isin(403, 404), F.concat(F.lit("fail_"), status.cast("string"))).otherwise("fail_other")


def largest_file(spark: SparkSession, folder: str, glob: str = "*.pdf", not_prefix: str = "RU_", least: int = 1024) -> DataFrame:
    """The largest file of each directory that is big enough and not of another language (S11, S22): contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length")
    own = files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    fits = own.where((F.col("length") > least) & ~F.col("name").startswith(not_prefix))
    return fits.withColumn("_n", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("length"), "path"))).where("_n = 1").drop("_n")


def manifest_ids(manifest: DataFrame) -> DataFrame:
    """Ids of a manifest in either form: a list, or lists by class."""
    return manifest.select(F.explode(F.coalesce("globalIds", F.flatten(F.map_values("by_class_globalIds")))).alias("gid"))


def text_source(texts: DataFrame, kind: str) -> DataFrame:
    """The text column that is asked for; rows without it are dropped."""
    return texts.where(F.col(kind).isNotNull()).select("gid", F.col(kind).alias("text"))


def report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table in order of the first column (S32); reports are small, and written as one file."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "at int, value string")
    body = rows.orderBy(columns[0]).select(F.lit(2).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("value"))
    return head.union(body).orderBy("at", "value").select("value")


def pack(downloads: DataFrame, folder: str) -> None:
    """Downloads(name, content) landed many to a file, Parquet of both columns: a file of its own for each would cost a folder, a rename and a listing each."""
    downloads.select("name", F.col("content").cast("binary").alias("content")).write.parquet(folder)


def packed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of what pack() landed; empty ones are there too."""
    return spark.read.schema("name string, content binary").parquet(folder)


def by_content(spark: SparkSession, folder: str, *, name: str = r"([^/]*)$", glob: str = "*", tiny: int = 10_000) -> DataFrame:
    """content_manifest of the files under a folder, each a file of its own.

    Spark reads no empty files: they have no row, and an empty folder gives none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return content_manifest(files.select(F.regexp_extract("path", name, 1).alias("name"), "content"), tiny=tiny)


def content_manifest(files: DataFrame, *, tiny: int = 10_000) -> DataFrame:
    """(name, sha256, bytes, status, kept_as) of each of files(name, content) (S22): ``rejected`` if it begins with no ``%PDF`` and is not
    over ``tiny`` bytes, ``duplicate`` if a file of a smaller name has the same content, else ``landed``.

    kept_as is the name that the content is kept under, null for rejected ones.  Contents are
    read once, for their digest and first bytes, and go no further; a content of very many
    copies is one row a task before digests meet.
    """
    own = files.select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("_pdf"))
    fits = own.withColumn("_fits", F.col("_pdf") | (F.col("bytes") > tiny))
    first = fits.where("_fits").groupBy("sha256").agg(F.min("name").alias("kept_as"))
    status = F.when(~F.col("_fits"), "rejected").when(F.col("name") == F.col("kept_as"), "landed").otherwise("duplicate")
    return fits.join(first, "sha256", "left").select("name", "sha256", "bytes", status.alias("status"), "kept_as")
