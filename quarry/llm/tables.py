"""Reading tables, keeping intermediate tables and labelling components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"  # driver and executor are one process here
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Session setting by which Spark deletes an execution's shuffle files as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to the shared folder (a folder for each value of ``by``) and read again: lineage is cut, and a lost executor loses nothing.

    The shuffle files behind df are not needed from then on and are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables that kept() wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def boxed(docs: DataFrame, apart: dict[str, Column], added: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """(rows, columns): the columns of ``docs`` but for ``added`` in one struct, beside ``apart``; and columns that take them out.

    So no column of the caller's meets one of ours.  A column that ``apart`` holds as it is
    stays out of the struct and is taken from there.
    """
    names = [c for c in docs.columns if c not in added]
    held = {c: k for k, v in apart.items() for c in names if isinstance(v, str) and v == c}
    fields = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c not in held]
    rows = docs.select(
        F.struct(*(fields or [F.lit(True).alias("none")])).alias("box"), *((F.col(f"`{v}`") if isinstance(v, str) else v).alias(k) for k, v in apart.items())
    )
    return rows, [(F.col(held[c]) if c in held else F.col(f"box.c{k}")).alias(c) for k, c in enumerate(names)]


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for the nodes of edges(a, b): the smallest node reachable.

    ``known``: what this gave for other edges, which count too and are not read again.
    Each round leads a node to its least neighbour and from there, by paths that halve,
    to one that has no smaller neighbour; the edges are then those between such nodes,
    so settled ones are not met again.  Nothing but emptiness reaches the driver.
    Null ends are dropped; an empty table gives an empty table.
    """
    whole = kept(_ordered(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")))
    nodes = whole.select("a").union(whole.select("b")).select(F.col("a").alias("node"), F.col("a").alias("component"))
    if known is not None:
        nodes = nodes.union(known.select("node", "component"))
    labels = nodes.groupBy("node").agg(F.min("component").alias("component"))
    pairs, written = whole if known is None else kept(_ordered(_led(whole, known))), [whole]
    while not pairs.isEmpty():
        up = _followed(pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")))
        labels = labels.join(_renamed(up, "component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        pairs = kept(_ordered(_led(pairs, up)))
        written += [up, pairs]
    labels = kept(labels)
    release(*written)
    return labels


def _ordered(pairs: DataFrame) -> DataFrame:
    """Different pairs of different ends, the smaller one first."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _renamed(labels: DataFrame, node: str, component: str) -> DataFrame:
    return labels.select(F.col("node").alias(node), F.col("component").alias(component))


def _led(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of the labels of their ends; an end without label stays."""
    both = pairs.join(_renamed(labels, "a", "to_a"), "a", "left").join(_renamed(labels, "b", "to_b"), "b", "left")
    return both.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))


def _followed(up: DataFrame) -> DataFrame:
    """Each node with the end of its path, where ``component`` is a smaller node or one without a row."""
    up = kept(up)
    while True:
        far = up.join(_renamed(up, "component", "far"), "component", "left")
        new = kept(far.select("node", F.coalesce("far", "component").alias("component"), F.col("far").isNotNull().alias("moved")))
        release(up)
        up = new.select("node", "component")
        up._kept_at = new._kept_at
        if new.where("moved").isEmpty():
            return up
