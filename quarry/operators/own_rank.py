"""Score of each document for its own key (R06) and that key's rank among all (R07), without a row for each document and term or key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text, words
from quarry.sources import landed

from . import index
from .index import B, K1

#: Numbers in the table of held weights (terms by keys) that is broadcast.
HELD = 1 << 23
#: Documents, and numbers of a product, that a task takes at once.
ROWS, STEP = 1024, 1 << 21
#: Words of a key's documents that are dealt out together at least, and for each term of the key, whose weights come with them.
SHARE, EACH = 1 << 20, 8


def _counted(batch: pa.RecordBatch, forms: list[int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, document, word, counts by form): each word of each document once, by document."""
    lists = [batch.column(k) for k in forms]
    flat = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    many = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    doc = np.concatenate([np.repeat(np.arange(batch.num_rows), m) for m in many])
    form = np.repeat(np.arange(len(forms)), [m.sum() for m in many])
    size = max(1, len(flat.dictionary))
    key, at = np.unique(doc * size + flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    counts = np.stack([np.bincount(at[form == f], minlength=len(key)) for f in range(len(forms))])
    return flat.dictionary, key // size, key % size, counts


def _lists(values: pa.Array, doc: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def _scored(shared, names: list[str]):
    """Rows (_row, key, a list of words by form) to (_row, key, score by form and key over held terms, the other terms with their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = shared.value
        c = weights.shape[1]
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                n = batch.num_rows
                found, doc, word, counts = _counted(batch, [2 + k for k in range(len(names))])
                place = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
                out = np.zeros((n, len(names) * c))
                held = np.flatnonzero(place >= 0)
                for a in range(0, len(held), max(1, STEP // c)):
                    some = held[a : a + max(1, STEP // c)]
                    own, first = np.unique(doc[some], return_index=True)
                    each = weights[place[some]]
                    for f in range(len(names)):
                        out[own, f * c : (f + 1) * c] += np.add.reduceat(each * counts[f][some][:, None], first, axis=0)
                rest = np.flatnonzero(place < 0)
                others = pa.StructArray.from_arrays([found.take(pa.array(word[rest])), *[pa.array(x[rest]) for x in counts]], names=["term", *names])
                scores = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * out.shape[1]).astype(np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores, _lists(others, doc[rest], n)], names=["_row", "key", "scores", "rest"])

    return run


def _ranked(keys: list[str], names: list[str]):
    """Rows (key, scores, met: (counts by form, at, weight) of the other terms) to (key, rank by form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_keys, c = pa.array(keys, pa.string()), len(keys)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                n = batch.num_rows
                own = pc.index_in(batch.column(0), value_set=all_keys).to_numpy(zero_copy_only=False).astype(np.int64)
                scores = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                met = batch.column(2)
                doc = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(met), 0).to_numpy(zero_copy_only=False))
                met = met.flatten()
                at, weight = met.field("at"), met.field("weight").flatten().to_numpy(zero_copy_only=False)
                many = pc.list_value_length(at).to_numpy(zero_copy_only=False)
                spot = np.repeat(doc, many) * c + at.flatten().to_numpy(zero_copy_only=False)
                ranks = []
                for f, name in enumerate(names):
                    count = np.repeat(met.field(name).to_numpy(zero_copy_only=False), many)
                    total = np.round(scores[:, f * c : (f + 1) * c] + np.bincount(spot, weight * count, n * c).reshape(n, c), 9)
                    mine = total[np.arange(n), own][:, None]
                    ahead = (total > mine) | ((total == mine) & (np.arange(c) < own[:, None]))
                    ranks.append(pa.array(1 + ahead.sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *ranks], names=["key", *names])

    return run


def own_ranks(docs: DataFrame, key: str, column: str, forms: dict[str, Column], held: int = HELD) -> DataFrame:
    """(key, ``{name}_rank`` of each form): for each row, the rank of its own key by the BM25 scores of the form's words over the texts of all keys.

    Keys are a code-sized list: their names pass through the driver.  The terms that would make the most
    rows (documents by keys) are held as a table of weights of ``held`` numbers, which a map over the
    documents reads; a document's other terms meet their postings by a join, and what they add comes back to
    it.  So a document is one row with a score for each key, as rank_of would give it: those that share no
    term score 0, and equal scores (nine places) go by key.  Rows without a key are left out.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(key).isNotNull())
    postings = landed.kept(index.build(docs, key, column, parts=True).postings)
    lengths = docs.select(F.col(key).alias("doc")).distinct().join(postings.groupBy("doc").agg(F.sum("tf").alias("dl")), "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).alias("dl"))
    sizes = sorted((r["doc"], r["dl"]) for r in lengths.collect())  # code-sized
    names, keys = list(forms), [k for k, _ in sizes]
    n, average = len(keys), sum(dl for _, dl in sizes) / max(1, len(keys))
    places = spark.createDataFrame([(k, at, K1 * (1 - B + B * dl / max(1.0, average))) for at, (k, dl) in enumerate(sizes)], "doc string, at int, norm double")
    each = postings.join(F.broadcast(places), "doc").groupBy("term")
    lines = each.agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("many"), F.collect_list(F.struct("at", (F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))).alias("weight"))).alias("p"))
    weight = F.transform("p", lambda p: index.idf(F.lit(n), F.col("df")) * p["weight"])
    lines = landed.kept(lines.select("term", F.floor(8 * F.log2(F.col("df") * F.col("many"))).cast("int").alias("cost"), F.col("p")["at"].alias("at"), weight.alias("weight")))
    cut, terms = 1 << 30, 0
    for r in lines.groupBy("cost").agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("cost")).collect():  # eight rows for each doubling
        terms += r["terms"]
        if terms * max(1, n) > held:
            break
        cut = r["cost"]
    often = lines.where(F.col("cost") >= cut).select("term", "at", "weight").toArrow().combine_chunks()  # at most ``held`` numbers
    weights = np.zeros((often.num_rows, n))
    if often.num_rows:
        lists = [often.column(k).combine_chunks() for k in ("at", "weight")]
        row = np.repeat(np.arange(often.num_rows), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
        weights[row, lists[0].flatten().to_numpy(zero_copy_only=False)] = lists[1].flatten().to_numpy(zero_copy_only=False)
    shared = spark.sparkContext.broadcast((pa.array(often.column("term").to_pylist(), pa.string()), weights))
    counts = ", ".join(f"{name}: long" for name in names)
    listed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), *[text.tokens(x).alias(name) for name, x in forms.items()])
    scored = landed.kept(listed.mapInArrow(_scored(shared, names), f"_row long, key string, scores array<double>, rest array<struct<term: string, {counts}>>"))
    rest = scored.select("_row", F.explode("rest").alias("r")).select("_row", "r.*")
    met = rest.join(lines.where(F.col("cost") < cut), "term").groupBy("_row").agg(F.collect_list(F.struct(*names, "at", "weight")).alias("met"))
    both = scored.select("_row", "key", "scores").join(met, "_row", "left").select("key", "scores", "met")
    ranks = both.mapInArrow(_ranked(keys, names), "key string, " + ", ".join(f"{name} long" for name in names))
    return ranks.select("key", *[F.col(name).alias(f"{name}_rank") for name in names])


def _totalled(names: list[str]):
    """Rows (key, share, kind, term, weight, text by form) by key, share and kind to (key, score by form) of each of kind 1: kind 0 are the terms of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, terms, weights, known = None, [], [], None
        for batch in batches:
            keys, shares, kinds = (batch.column(k).to_pylist() for k in range(3))
            cuts = [k for k in range(1, len(keys)) if (keys[k], shares[k], kinds[k]) != (keys[k - 1], shares[k - 1], kinds[k - 1])]
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                if (keys[lo], shares[lo]) != group:
                    group, terms, weights, known = (keys[lo], shares[lo]), [pa.array([], pa.string())], [np.zeros(0)], None
                if not kinds[lo]:
                    terms.append(batch.column(3).slice(lo, hi - lo))
                    weights.append(batch.column(4).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                    continue
                if known is None:
                    known, weight = words.known(pa.concat_arrays(terms)), np.concatenate(weights)
                scores = []
                for f in range(len(names)):
                    texts, out = batch.column(5 + f).slice(lo, hi - lo), np.zeros(hi - lo)
                    for a, b in words.slices(texts):
                        row, term, _ = words.places(texts.slice(a, b - a), known)
                        out[a:b] = np.bincount(row, weight[term], b - a)
                    scores.append(pa.array(out))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *scores], names=["key", *names])

    return run


def own_totals(docs: DataFrame, key: str, column: str, forms: dict[str, Column]) -> DataFrame:
    """(key, score of each form): for each row, the BM25 score of the form's words for its own key, whose document are the texts of its rows.

    Keys are a code-sized list.  A key's documents are dealt out in shares, and the weights of its terms are
    copied to each; a share has EACH words for each term at least, so that the copies are fewer rows than the
    documents have words.  Texts are shuffled once, no row for each document and term; a task holds the terms
    of one key.  ``forms`` read ``column`` alone and are made after the shuffle.  Rows without a key score 0.
    """
    spark = docs.sparkSession
    named = docs.where(F.col(key).isNotNull())
    postings = landed.kept(index.build(named, key, column, parts=True).postings)
    counts = postings.groupBy("doc").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("terms"))
    sizes = named.select(F.col(key).alias("doc")).distinct().join(counts, "doc", "left").select("doc", F.coalesce("dl", F.lit(0)), F.coalesce("terms", F.lit(0))).collect()  # code-sized
    n, average = len(sizes), sum(dl for _, dl, _ in sizes) / max(1, len(sizes))
    dealt = [(k, K1 * (1 - B + B * dl / max(1.0, average)), 1 + dl // max(SHARE, EACH * m)) for k, dl, m in sizes]
    places = F.broadcast(spark.createDataFrame(dealt, "_key string, _norm double, _shares long"))
    lines = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.collect_list(F.struct("doc", "tf")).alias("p")).select("term", "df", F.inline("p"))
    weight = index.idf(F.lit(n), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("_norm"))
    weighed = lines.withColumnRenamed("doc", "_key").join(places, "_key").select(
        "_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"), F.lit(0).alias("_kind"), F.col("term").alias("_term"), weight.alias("_weight"), F.lit(None).cast("string").alias(column)
    )
    texts = docs.select(F.col(key).alias("_key"), F.col(column), F.monotonically_increasing_id().alias("_row")).join(places, "_key", "left").select(
        "_key", F.coalesce(F.pmod("_row", "_shares"), F.lit(0)).alias("_share"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_term"), F.lit(None).cast("double").alias("_weight"), column
    )
    both = weighed.union(texts).repartition("_key", "_share").sortWithinPartitions("_key", "_share", "_kind")
    made = both.select("_key", "_share", "_kind", "_term", "_weight", *[x.alias(name) for name, x in forms.items()])
    return made.mapInArrow(_totalled(list(forms)), "key string, " + ", ".join(f"{name} double" for name in forms))
