"""Time-ordered target encoding: what was known of a key before each moment, from a dyadic time tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept, release, table
from .words import trimmed

#: Rows that a leaf of a key's tree holds on average, at most.
LEAF = 64
#: A node is copied once for each 2**COPY_BITS leaves that may ask for it.
COPY_BITS = 12
#: A key: what it is a value of, and the value.
KEY = ["col", "id"]


def _within(folds: int):
    """Arrow batches of moments sorted by key, leaf and time -> the same with sums over the leaf's earlier moments, and no sums; and for each leaf a row with its own."""

    def leaves(rows: pa.Table) -> pa.RecordBatch:
        col, id, leaf, at, fold, n, s = (rows.column(k).to_numpy() for k in range(7))
        size = len(at)
        new_leaf = np.ones(size, bool)
        new_leaf[1:] = (col[1:] != col[:-1]) | (id[1:] != id[:-1]) | (leaf[1:] != leaf[:-1])
        new_moment = new_leaf.copy()
        new_moment[1:] |= at[1:] != at[:-1]
        starts, moments = np.flatnonzero(new_leaf), np.flatnonzero(new_moment)
        of_leaf, of_moment = np.cumsum(new_leaf) - 1, np.cumsum(new_moment) - 1
        here, whole = [], []
        for x in (n, s):
            by_fold = np.zeros((size + 1, folds), np.int64)
            by_fold[np.arange(1, size + 1), fold] = x
            np.cumsum(by_fold, axis=0, out=by_fold)
            here.append(by_fold[moments][of_moment] - by_fold[starts][of_leaf])
            whole.append(by_fold[np.append(starts[1:], size)] - by_fold[starts])
        at_leaf = lambda x: np.concatenate([x, x[starts]])
        ends = [np.concatenate([x.sum(1) - x[np.arange(size), fold], np.zeros(len(starts), np.int64)]) for x in here]
        places = np.concatenate([np.zeros(size, np.int32), np.arange(len(starts) + 1, dtype=np.int32) * (2 * folds)])
        sums = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(whole, axis=1).ravel()))
        return pa.RecordBatch.from_arrays([*(pa.array(at_leaf(x)) for x in (col, id, leaf, at, fold)), *map(pa.array, ends), sums], names=[*KEY, "leaf", "at", "fold", "n", "s", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the leaf that the last batch did not end
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(k).to_numpy() for k in range(3)]
            same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut or (held and any(held[-1].column(k)[-1].as_py() != key[k][0] for k in range(3))):
                yield leaves(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield leaves(pa.Table.from_batches(held))

    return trimmed(run)


def history(rows: DataFrame, *, folds: int = 5, leaf: int = LEAF, by: str | None = None, span: DataFrame | None = None) -> DataFrame:
    """(col, id, at, fold, n, s) for each key, moment and fold of ``rows``: sums over the key's earlier rows of other folds; a table (kept by ``by``).

    ``rows`` has col and id (a key: a byte and a long), size (the same for all rows of a key:
    at least how many there are, or about), at (long), fold (0 to ``folds`` - 1), n and s,
    none null.

    The span of time is halved until a key of ``size`` rows has about ``leaf`` of them in a
    leaf: a hot key has a deep tree, a rare one a single leaf.  Nodes are numbered as in a
    heap: the root is 1, the children of k are 2k and 2k + 1.  Each leaf adds its sums to
    those of its ancestors that are left children, one row a key and node with a sum for each
    fold.  Each leaf that has rows explodes the time before it into the nodes that make it up
    (the left siblings of those of its ancestors that are right children, as many as its
    number has ones), joins them by equality and adds them.  What is earlier within the leaf
    comes from running sums over its sorted moments.  All folds minus the own one are the history.

    A node is asked for by as many leaves as its sibling covers, so it is copied once for
    each 2**12 of them.  Rows of one key, moment and fold are one row after the first sum, so
    no leaf gathers more rows than its moments and folds, whatever its key's share of the
    rows.  Nothing but the first and last moment (of ``span``, where given: rows with all the
    moments) reaches the driver.

    An empty table gives an empty table; ties in time are no history of each other.
    """
    first = (rows if span is None else span).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo = first["lo"] or 0
    bits = max(1, ((first["hi"] or 0) - lo).bit_length())
    depth = F.least(F.lit(bits), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / leaf)))).cast("int")
    placed = rows.withColumn("depth", depth).withColumn("leaf", F.expr(f"shiftright(at - {lo}L, {bits} - depth) + shiftleft(1L, depth)"))
    moments = placed.groupBy(*KEY, "leaf", "at", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    name = F.xxhash64(*KEY, "leaf").alias("name")  # first in sorts, which its first eight bytes nearly decide
    dealt = moments.repartition(*KEY, "leaf").sortWithinPartitions(name, *KEY, "leaf", "at")
    sums = [f"{c}{f}" for c in "ns" for f in range(folds)]
    both = kept(dealt.mapInArrow(_within(folds), "col byte, id long, leaf long, at long, fold int, n long, s long, sums array<long>"))

    height = F.length(F.conv("leaf", 10, 2)) - 1
    leaves = kept(both.where("size(sums) > 0 AND leaf > 1").select(*KEY, "leaf", *(F.col("sums")[k].alias(x) for k, x in enumerate(sums))))
    steps = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), height - 1))).withColumn("node", F.expr("shiftright(leaf, level)"))
    summed = [F.sum(x).alias(x) for x in sums]
    nodes = steps.where("node & 1 = 0").groupBy(*KEY, "level", "node").agg(*summed)
    first_asking, last_asking = F.expr("shiftleft(node + 1, level)"), F.expr("shiftleft(node + 2, level) - 1")
    copies = nodes.withColumn("copy", F.explode(F.sequence(F.shiftright(first_asking, COPY_BITS), F.shiftright(last_asking, COPY_BITS))))
    probes = steps.where("node & 1 = 1").select(*KEY, "leaf", "level", (F.col("node") - 1).alias("node"), F.shiftright("leaf", COPY_BITS).alias("copy"))
    before = probes.join(copies, [*KEY, "level", "node", "copy"]).groupBy(*KEY, "leaf").agg(*summed)

    all_folds = before.select(name, *KEY, "leaf", F.array(*sums[:folds]).alias("n_before"), F.array(*sums[folds:]).alias("s_before"))
    others = lambda c: sum((F.when(F.col("fold") != f, F.coalesce(F.col(f"{c}_before")[f], F.lit(0))).otherwise(0) for f in range(folds)), F.col(c))
    out = both.where("size(sums) = 0").select(name, *KEY, "leaf", "at", "fold", "n", "s").join(all_folds, ["name", *KEY, "leaf"], "left")
    out = kept(out.select(*KEY, "at", "fold", others("n").alias("n"), others("s").alias("s")), by=by)
    release(both, leaves)
    return out


def rate(n: str, s: str, prior: str, weight: int = 50) -> Column:
    """Millionths: the prior where there is no history, else the share of s, drawn to the prior as if by ``weight`` rows."""
    return F.expr(f"CASE WHEN {n} < 1 THEN {prior} ELSE (1000000L * {s} + {weight}L * {prior}) div ({n} + {weight}L) END")


def _sized(counted: DataFrame, known: DataFrame, id: str, group: str) -> DataFrame:
    """(id, its size, group_id, its size): how many counted rows an id and its group have.

    A group goes by the least id in it, below all ids where it holds the null id.  An id that
    several rows know takes the least group.
    """
    both = counted.select(id, F.lit(None).cast(known.schema[group].dataType).alias(group), F.lit(1).alias("n"))
    both = both.unionByName(known.where(F.col(id).isNotNull()).select(id, group, F.lit(0).alias("n")))
    ids = kept(both.groupBy(id).agg(F.min(group).alias(group), F.sum("n").alias(f"{id}_size")).where(f"{id}_size > 0"))
    groups = ids.groupBy(F.col(group).alias("_group")).agg(F.min(F.coalesce(id, F.lit(_NO_ID))).alias(f"{group}_id"), F.sum(f"{id}_size").alias(f"{group}_size"))
    out = kept(ids.join(groups, F.col(group).eqNullSafe(F.col("_group"))).drop("_group", group))
    release(ids)
    return out


#: Stands for the null vendor inside.
_NO_ID = -(1 << 63)


def encode(
    lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, *, folds: int = 5, weight: int = 50, leaf: int = LEAF
) -> DataFrame:
    """Rows of sale_id, item_id and vendor_id with their own lines and with what was known of item, vendor and client when they were sold.

    Lines join sales on sale_id (lines without a sale, and sales without a time, drop).
    A line's history is all lines of sales of other folds (crc32 of the sale's digits) sold
    before.  Rates are drawn to the rate of the item's kind, the vendor's nation or the
    client's segment, and those to the rate of all history: one chain of priors.  Added:
    n_lines, n_returned and, for item, vendor and client, _n and _rate.

    Sums per key, moment and fold come from history(); each is then joined to the rows by
    (key, moment, fold).  All joins are equi-joins of two shuffled sides, so a hot key, sale
    or moment is split by Spark; kinds, nations, segments and all history are keys like others.

    Edge cases: null item and client are -1, an id like others; a null vendor is one vendor;
    a null or unknown kind, nation or segment is one value; repeated lines count, repeated
    sales join each line as often; an id that several rows describe takes its least group;
    other columns, whatever their names, are not read; an empty table gives an empty table.
    """
    at = F.unix_micros(F.col("sold_at").cast("timestamp"))
    lines = lines.select("sale_id", F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), F.coalesce(F.col("vendor_id").cast("long"), F.lit(_NO_ID)).alias("vendor_id"), "flag")
    sales = sales.where("sold_at IS NOT NULL AND sale_id IS NOT NULL").select(
        "sale_id", F.coalesce("client_id", F.lit(-1)).cast("long").alias("client_id"), at.alias("at"), F.pmod(F.crc32(F.col("sale_id").cast("string")), F.lit(folds)).cast("int").alias("fold")
    )
    own = lines.where("sale_id IS NOT NULL").groupBy("sale_id", "item_id", "vendor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("flag") == "returned", F.lit(False))).alias("s")
    )
    dimensions = [_sized(lines, items, "item_id", "kind"), _sized(lines, vendors, "vendor_id", "nation_id"), _sized(sales, clients, "client_id", "segment")]
    every = dimensions[0].agg(F.sum("item_id_size")).first()[0] or 0
    sold = sales.groupBy("sale_id", "client_id", "at", "fold").agg(F.count(F.lit(1)).alias("times")).join(dimensions[2], "client_id")
    whole = own.join(dimensions[0], "item_id").join(dimensions[1], "vendor_id").join(sold, "sale_id")
    whole = kept(whole.withColumns({"n": F.expr("n * times"), "s": F.expr("s * times"), "all_id": F.lit(0).cast("long"), "all_size": F.lit(every).cast("long")}).drop("times"))
    keys = ["all", "kind", "item", "nation_id", "vendor", "segment", "client"]
    parts = [F.struct(F.lit(k).cast("byte").alias("col"), F.col(f"{c}_id").alias("id"), F.col(f"{c}_id_size" if c in ("item", "vendor", "client") else f"{c}_size").alias("size")) for k, c in enumerate(keys)]
    rows = whole.select("at", "fold", "n", "s", F.inline(F.array(*parts)))
    past = history(rows, folds=folds, leaf=leaf, by="col", span=whole)

    def with_past(df: DataFrame, key: str) -> DataFrame:
        found = past.where(F.col("col") == keys.index(key)).select(F.col("id").alias(f"{key}_id"), "at", "fold", F.col("n").alias(f"{key}_n"), F.col("s").alias(f"{key}_s"))
        return df.join(found, ["at", f"{key}_id", "fold"])

    sold = whole.select("sale_id", "at", "fold", "client_id", "segment_id", "all_id").distinct()
    for key in ("all", "segment", "client"):
        sold = with_past(sold, key)
    sold = sold.withColumn("all_rate", rate("all_n", "all_s", "500000L", weight)).withColumn("segment_rate", rate("segment_n", "segment_s", "all_rate", weight))
    sold = sold.select("sale_id", "at", "client_id", "all_rate", "client_n", rate("client_n", "client_s", "segment_rate", weight).alias("client_rate"))
    out = whole.select("sale_id", "item_id", "vendor_id", "kind_id", "nation_id_id", "client_id", "at", "fold", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"))
    for key in ("item", "kind", "vendor", "nation_id"):
        out = with_past(out, key)
    out = out.join(sold, ["sale_id", "at", "client_id"])
    out = out.withColumn("kind_rate", rate("kind_n", "kind_s", "all_rate", weight)).withColumn("nation_rate", rate("nation_id_n", "nation_id_s", "all_rate", weight))
    return out.select(
        "sale_id", "item_id", F.when(F.col("vendor_id") != _NO_ID, F.col("vendor_id")).alias("vendor_id"), "n_lines", "n_returned",
        "item_n", rate("item_n", "item_s", "kind_rate", weight).alias("item_rate"),
        "vendor_n", rate("vendor_n", "vendor_s", "nation_rate", weight).alias("vendor_rate"), "client_n", "client_rate",
    )


def op12_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))
