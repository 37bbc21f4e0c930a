"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo 2^31 - 1 and for two bases, the polynomial
hash of each of its prefixes. Any span's hash follows from two entries, so spans
compare in constant time, and the longest common extension of two places is found by
binary search. A fingerprint has the length, the hash of the whole text, and
the least span hash in each of ``BINS`` bins, over all spans of ``SPAN`` code points;
the share of bins that agree estimates how many spans two texts share.

Documents are dealt into runs of adjacent ids, each followed by a copy of the
document that comes next, and tasks pass once over a run, two documents at a time. Runs are cut at quantiles of
the ids and evenly within these, and grow in number with the documents up to ``RUNS``; null ids, and an id
that repeats without end, are cut by a hash of the text instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import ship_by_value, staged

MODULUS = (1 << 31) - 1
BASES = (911382323, 1972663201)
SPAN, BINS = 12, 64
#: Documents in a run, the most runs (beyond, runs get longer: at 5 * 10^10 documents of 2 KB, 100 MB each), and at how many quantiles ids are cut first.
RUN, RUNS, QUANTILES = 8000, 1_000_000, 4000
#: Tasks that runs are dealt to at most.
TASKS = 20_000
_EMPTY = 0xFFFF


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1."""
    x = (x & np.uint64(MODULUS)) + (x >> np.uint64(31))
    x = (x & np.uint64(MODULUS)) + (x >> np.uint64(31))
    return np.where(x >= MODULUS, x - np.uint64(MODULUS), x)


class Powers:
    """Powers of the bases and of their inverses, grown to the longest text so far."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def grow(self, n: int) -> None:
        for k, base in enumerate(BASES):
            for tables, by in ((self.up, base), (self.down, pow(base, -1, MODULUS))):
                while len(tables[k]) < n:
                    more = np.uint64(pow(by, len(tables[k]), MODULUS))
                    tables[k] = np.concatenate([tables[k], _reduce(tables[k] * more)])


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str, powers: Powers) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.powers = len(points), powers
        powers.grow(self.n + 1)
        # Entry i is the sum of point[j] / base^j over j < i: a span's hash is a difference, scaled by base^start.
        self.sums = [np.concatenate([np.zeros(1, np.uint64), _reduce(np.cumsum(_reduce(points * powers.down[k][: self.n])))]) for k in range(len(BASES))]

    def spans(self, width: int, k: int = 0) -> np.ndarray:
        """The hashes of all spans of ``width`` for one base."""
        diff = self.sums[k][width:] + np.uint64(MODULUS) - self.sums[k][: self.n + 1 - width]
        return _reduce(_reduce(diff) * self.powers.up[k][: self.n + 1 - width])

    def span(self, start: int, width: int) -> tuple[int, ...]:
        return tuple((int(s[start + width]) - int(s[start])) * int(up[start]) % MODULUS for s, up in zip(self.sums, self.powers.up, strict=True))

    def common(self, start: int, other: Prefixes, there: int) -> int:
        """How many code points agree from ``start`` here and ``there`` in the other text."""
        low, high = 0, min(self.n - start, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.span(start, middle) == other.span(there, middle) else (low, middle - 1)
        return low

    def sketch(self) -> np.ndarray:
        """The least span hash of each bin, 16 bits of it; ``_EMPTY`` where there is none."""
        out = np.full(BINS, _EMPTY, np.uint64)
        if not self.n:
            return out
        mixed = self.spans(min(SPAN, self.n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        bins = (mixed >> np.uint64(58)).astype(np.intp)
        np.minimum.at(least, bins, mixed)
        filled = least != np.iinfo(np.uint64).max
        out[filled] = (least[filled] >> np.uint64(20)) % np.uint64(_EMPTY)
        return out

    def fingerprint(self) -> str:
        whole = "".join(f"{x:08x}" for x in self.span(0, self.n))
        return f"{self.n:x}-{whole}-" + self.sketch().astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of bins in which two fingerprints agree; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u2") for f in (a, b))
    held = (x != _EMPTY) | (y != _EMPTY)
    return float(((x == y) & held).sum() / held.sum()) if held.any() else 0.0


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_head long, same_tail long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, copy, doc_id, text) in order; the row after each is the document next to it."""
    powers, held, rows = Powers(), None, []

    def out() -> pa.RecordBatch:
        names = [x.split()[0] for x in _OUT.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(_OUT.split(", "))], names=names)

    for batch in batches:
        for run, copy, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Prefixes(text, powers)
            print_ = own.fingerprint()
            if held is not None and held[0] == run:
                _, old_id, old_text, old, old_print = held
                cut = len(old_text) // 3
                edited_text = old_text[: len(old_text) - cut] + text[:cut]
                edited = Prefixes(edited_text, powers)
                edited_print = edited.fingerprint()
                sha = hashlib.sha256(edited_text.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((old_id, old.n, sha, old_print, edited_print, likeness(old_print, edited_print), likeness(old_print, print_), old.common(0, edited, 0), edited.common(old.n - cut, own, 0)))
            held = None if copy else (run, doc_id, text, own, print_)
            if len(rows) >= 500:
                yield out()
                rows.clear()
    if rows:
        yield out()


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text.

    The edited text has the last third of its code points replaced by the first as
    many of the next document's, by descending doc_id; the first comes after the
    last. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and by binary search same_head (code points that text and edited text share at
    their start) and same_tail (that the edited text's new part shares with the next document's start). Null
    text counts as empty. A null doc_id comes last; rows that share a doc_id
    follow each other by their texts' xxhash64. A single document is its own next one. An
    empty table gives no rows; other columns are ignored.
    """
    ship_by_value()
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    count, nulls = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    size = max(run, -(-count // RUNS))
    runs = max(1, -(-count // size))
    quantiles = min(runs, QUANTILES)
    ends = docs.stat.approxQuantile("doc_id", [k / quantiles for k in range(quantiles + 1)], 0.1 / quantiles) if quantiles > 1 else []
    ends = np.array(ends, np.int64)
    # An id at which quantiles meet gets an interval of its own.
    alone = np.unique(ends[1:][ends[1:] == ends[:-1]])
    bounds = np.unique(np.concatenate([ends[1:-1], alone, alone + 1]))
    each = -(-runs // quantiles)  # runs in an interval, or in that of an id on its own as many as it has
    shares = {int(x): -(-runs * int((ends == x).sum()) // quantiles) for x in alone}

    @F.pandas_udf("long")
    def run_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        """Ascending with the id; null comes first, as it is last by descending id. Rows of one id on its own ascend against the order of digests."""
        known = ids.fillna(0).to_numpy(np.int64)
        interval = np.searchsorted(bounds, known, side="right")
        low, high = (np.concatenate(x).astype(np.float64)[interval] for x in (([ends[0] if len(ends) else 0], bounds), (bounds, [ends[-1] + 1 if len(ends) else 1])))
        place = np.clip((known - low) / np.maximum(high - low, 1), 0, 1 - 1e-9)
        parts = np.full(len(known), each)
        by_hash = 1 - 1e-9 - (digests.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5) * (1 - 2e-9)
        for x, n in shares.items():
            mine = known == x
            place[mine], parts[mine] = by_hash[mine], n
        interval += 1
        null = ids.isna().to_numpy()
        interval[null], place[null], parts[null] = 0, by_hash[null], -(-nulls // size) or 1
        return pd.Series(interval * (1 << 32) + np.floor(place * parts).astype(np.int64))

    dealt = texts.select("doc_id", "text", "digest", run_of("doc_id", "digest").alias("run"))
    # The first document of each run follows the last one of the run before it, and that of the first run the last one.
    first = dealt.groupBy("run").agg(F.max(F.struct("doc_id", F.bitwise_not("digest").alias("order"))).alias("head"))
    in_order = Window.orderBy("run")
    place = F.row_number().over(in_order) - 1
    heads = first.select("run", place.alias("place"), F.col("head.doc_id").alias("head"), F.bitwise_not("head.order").alias("head_digest"))
    heads = staged(heads, "run-heads")  # a row for each run
    n = heads.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    parts = min(n, TASKS)  # runs that follow each other share a task if there are more
    follows = F.broadcast(heads.select(F.pmod(F.col("place") + 1, F.lit(n)).alias("place"), "head", "head_digest"))
    copies = texts.join(follows, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("digest") == F.col("head_digest")))
    copies = copies.groupBy("place").agg(F.min(F.struct("text", "doc_id", "digest")).alias("x")).select("place", F.lit(1).alias("copy"), "x.doc_id", "x.text", "x.digest")
    rows = dealt.join(F.broadcast(heads.select("run", "place")), "run").select("place", F.lit(0).alias("copy"), "doc_id", "text", "digest")
    rows = rows.unionByName(copies).repartitionById(parts, F.floor(F.col("place") * parts / n).cast("int")).sortWithinPartitions("place", "copy", F.desc("doc_id"), "digest", "text")
    return rows.drop("digest").mapInArrow(_pairs, _OUT)
