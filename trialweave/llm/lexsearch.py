"""Ranked lexical search with blocked posting lists and exact bounds.

A document's score for an item sums, over the item's terms, a weight times the term's saturated share in the
document, all in whole numbers; the highest scores are found without scoring every document.

1. Documents become counts of the items' terms, once; corpus statistics are sums over all documents.
2. A task indexes documents in shards of bounded size. A term's posting list is clustered by
   similarity of the documents (random projections of their term vectors, around members of the list) into blocks of about ``BLOCK``, and a block keeps
   the greatest value of each coordinate, its summary.
3. An item takes its terms from the heaviest on. A document of a list that wasn't met before has none of the heavier
   terms, so the summary's other coordinates bound its score. A block is skipped only if that bound is below
   the least score that can still count, and all further lists if the shard's own greatest values are. What is left is scored exactly.
4. That least score starts from the best of a part of the documents (``FIRST``), which is a lower bound for the best of all.

Items are taken in groups of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import arrow_batches, ship_by_value, staged

#: Documents for an item, and factors of the saturation: 100 * (1 - B), 100 * B, and K * 10.
TOP, FLAT, SLOPE, SATURATION = 20, 75, 25, 12
#: Documents in a block, in a shard, cells of a shard's matrix, terms in a group of items (but for a single longer item).
BLOCK, SHARD, CELLS, TERMS = 64, 4096, 24_000_000, 20_000
#: Of the documents, one in so many gives the first bounds; dimensions of a projection; texts in a batch.
FIRST, DIMENSIONS, BATCH = 64, 16, 500
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII of a UTF-8 text, A-Z in lower case."""
    return (text or b"").translate(_TABLE).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def shares(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The saturated share of terms that stand ``tf`` times in documents of ``n`` terms."""
    return 1_000_000_000 * tf // (1000 * tf + SATURATION * (FLAT + SLOPE * n * documents // max(total, 1)))


class Shard:
    """Some documents' vectors over the items' terms, with posting lists that are blocked when they are first asked for."""

    def __init__(self, ids: list[int | None], matrix: np.ndarray, items: list[np.ndarray], where: dict[int, list[tuple[int, int]]]) -> None:
        self.ids, self.matrix, self.items, self.where, self.kept = ids, matrix, items, where, 0
        self.most = matrix.max(axis=0).astype(np.float64)
        signs = np.random.default_rng(matrix.shape[1]).choice(np.array([-1, 1], np.float32), (matrix.shape[1], DIMENSIONS))
        self.near = np.log1p(matrix) @ signs
        self.near /= np.maximum(np.sqrt((self.near**2).sum(axis=1, keepdims=True)), 1e-9)
        self.lists: dict[int, tuple[np.ndarray, ...]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, ...]:
        """A term's documents by block, where blocks begin, which coordinates are asked for, and the blocks' summaries over these.

        They are the term and the lighter ones of all items that have it. Lists are kept for other items as long as there is room.
        """
        found = self.lists.get(term)
        if found is None:
            docs = np.flatnonzero(self.matrix[:, term])
            around = docs[::BLOCK]
            block = (self.near[docs] @ self.near[around].T).argmax(axis=1) if len(docs) else docs
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            columns = np.unique(np.concatenate([self.items[i][k:] for i, k in self.where[term]]))
            own = np.concatenate([np.maximum.reduceat(self.matrix[np.ix_(docs, columns[a : a + 256])], starts, axis=0) for a in range(0, len(columns), 256)], axis=1) if len(docs) else np.zeros((0, len(columns)), np.float32)
            found = docs, starts, columns, own
            if self.kept + own.size <= CELLS:
                self.lists[term] = found
                self.kept += own.size
        return found

    def best(self, item: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best documents of ``item``, its terms from the heaviest on, with scores of ``least`` and more, above 0."""
        seen, held, scores = np.zeros(len(self.ids), bool), np.empty(0, np.int64), np.empty(0)
        after = np.append(np.cumsum((self.most[item] * weights)[::-1])[::-1], 0)
        least = max(least, 1)
        for k, term in enumerate(item):
            if after[k] < least:
                break
            docs, starts, columns, summaries = self.postings(int(term))
            if not len(docs):
                continue
            bounds = summaries[:, np.searchsorted(columns, item[k:])].astype(np.float64) @ weights[k:]
            ends = np.append(starts[1:], len(docs))
            # The most promising blocks first, a few at a time.
            order = np.argsort(-bounds, kind="stable")
            for a in range(0, len(order), 8):
                part = order[a : a + 8]
                part = part[bounds[part] >= least]
                if not len(part):
                    break
                found = np.concatenate([docs[starts[b] : ends[b]] for b in part])
                found = found[~seen[found]]
                seen[found] = True
                own = self.matrix[np.ix_(found, item)].astype(np.float64) @ weights
                fit = own >= least
                held, scores = np.append(held, found[fit]), np.append(scores, own[fit])
                if len(held) >= TOP:
                    least = max(least, int(np.partition(scores, -TOP)[-TOP]))
                    held, scores = held[scores >= least], scores[scores >= least]
        return held, scores.astype(np.int64)


def _counted(vocabulary: dict[bytes, int]):
    """(doc_id, text) to the number of a document's terms, and its counts of those in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, held, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = terms(text.as_py())
                known = np.fromiter(filter(None, map(vocabulary.get, found)), np.int32)
                own, tf = np.unique(known, return_counts=True)
                sizes.append(len(found))
                held.append(own)
                counts.append(tf)
            offsets = pa.array(np.cumsum([0, *map(len, held)], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int32))) for x in (held, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return run


def places(items: list[np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """The items that have each term, and its place in them."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for k, term in enumerate(item.tolist()):
            out.setdefault(term, []).append((i, k))
    return out


def _ranked(items: list[tuple[np.ndarray, np.ndarray]], width: int, least: dict[int, int], documents: int, total: int):
    """Counts of documents to the best of each item in each shard."""

    def best(held: list[tuple]) -> pa.RecordBatch:
        matrix = np.zeros((len(held), width), np.float32)  # shares are below 2 ** 24, so these are exact
        for i, (_, n, own, tf) in enumerate(held):
            matrix[i, own] = shares(tf.astype(np.int64), np.int64(n), documents, total)
        own = [item for item, _ in items]
        shard, out = Shard([h[0] for h in held], matrix, own, places(own)), []
        for k, (item, weights) in enumerate(items):
            docs, scores = shard.best(item, weights, least.get(k, 0))
            order = sorted(range(len(docs)), key=lambda i: (-scores[i], shard.ids[docs[i]] is None, shard.ids[docs[i]] or 0))[:TOP]
            out += [(k, shard.ids[docs[i]], int(scores[i])) for i in order]
        k, ids, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["k", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held = max(1, min(SHARD, CELLS // width)), []
        for batch in batches:
            own, tf = ([x.to_numpy() for x in (c.values.slice(a, b - a) for a, b in zip(c.offsets.to_numpy()[:-1], c.offsets.to_numpy()[1:], strict=True))] for c in batch.columns[2:])
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own, tf, strict=True):
                held.append(row)
                if len(held) == most:
                    yield best(held)
                    held = []
        if held:
            yield best(held)

    return run


def _group(docs: DataFrame, items: list[tuple[int, int | None, str | None]]) -> DataFrame:
    """k, doc_id and score: the best documents of each of ``items`` (k, item_id, text)."""
    spark, found = docs.sparkSession, [terms((text or "").encode("utf-8", "surrogatepass")) for _, _, text in items]
    vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for x in found for t in x), 1)}
    with arrow_batches(spark, BATCH):
        counted = staged(docs.select("doc_id", "text").mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"), "term-counts")
    documents, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # As many rows as the group has terms.
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
    weights = np.array([0, *(weight(documents, df[k]) if k in df else 0 for k in vocabulary.values())], np.int64)
    vectors = []
    for x in found:
        own, times = np.unique(np.array([vocabulary[t] for t in x], np.int64), return_counts=True)
        own, times = own[weights[own] > 0], times[weights[own] > 0]
        order = np.lexsort((own, -weights[own]))
        vectors.append((own[order], (weights[own] * times)[order].astype(np.float64)))
    width, schema = len(weights), "k long, doc_id long, score long"
    some = counted.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0)
    first = _best(some.mapInArrow(_ranked(vectors, width, {}, documents, total), schema))
    least = {r["k"]: r["least"] for r in first.groupBy("k").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == TOP).collect()}
    return _best(counted.mapInArrow(_ranked(vectors, width, least, documents, total), schema))


def _best(found: DataFrame) -> DataFrame:
    """The first of each item, with their rank; Spark keeps only so many of each before it shuffles."""
    order = Window.partitionBy("k").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _groups(items: DataFrame) -> Iterator[list[tuple[int, int | None, str | None]]]:
    """Items in groups of about ``TERMS`` terms; they come one after another, so that no more than a group is held."""
    held, size = [], 0
    for k, r in enumerate(items.toLocalIterator()):
        own = len(terms((r["text"] or "").encode("utf-8", "surrogatepass")))
        if held and size + own > TERMS:
            yield held
            held, size = [], 0
        held.append((k, r["item_id"], r["text"]))
        size += own
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score: the documents of ``docs`` (doc_id, text) that score best for each of ``items`` (item_id, text).

    There are at most ``TOP`` for an item, all with scores above 0; equal scores are ranked by doc_id, null last. Null and empty texts have no
    terms: such items have no rows, such documents are none's. Rows that repeat an item_id are items of their own, and rows that repeat a doc_id documents of their own.
    Empty tables give no rows; other columns are ignored.
    """
    ship_by_value()
    spark = docs.sparkSession
    out = None
    for group in _groups(items.select("item_id", "text")):
        names = spark.createDataFrame([(n, item_id) for n, (_, item_id, _) in enumerate(group)], "k long, item_id long")
        found = staged(_group(docs, group), "ranked").join(F.broadcast(names), "k").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
