"""Near-duplicate documents by one-permutation MinHash.

A document's set of 5-word shingles is hashed once; each of ``BINS`` bins keeps the least
hash that falls into it, and an empty bin borrows from a bin that a hash of its own
number points to, tried again until that bin is filled (optimal densification).
``BANDS`` bands of ``ROWS`` bins are bucket keys. At similarity 0.75 two
documents miss each other in all bands once in 200,000 pairs.

1. Documents with equal sets form a class, named by 64 bits of the set's hash (``node``). Everything
   up to the last step is about classes, so copies cost nothing and repeated doc_ids make no difference.
2. In each bucket, every class is paired with the smallest one: a star, so there are as many
   pairs as members. Pairs are confirmed on full sets, which are made once, for
   the classes that share a bucket, and staged.
3. Confirmed links are joined to components. A bucket whose members are in one
   component needs no more pairs. In the others, ``STARS`` more around other
   members follow, across components only.
4. For members of buckets that still have several components, all links
   across components are found exactly: similar sets share one of the rarest shingles of
   each (a prefix of a quarter, by how many components have a shingle) early enough, so only classes that
   do are paired. Documents that have just a common passage in
   common share none of these.
5. Classes that share a doc_id are linked, and a component gets the smallest doc_id of its documents.

Signatures and sets are made in tasks with numpy; all grouping and joining is
Spark's. A bucket or class that holds more than one in ``HOT`` of all rows has what it is joined with broadcast
(there are at most ``HOT`` such keys), so its members are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import arrow_batches, discard, release, ship_by_value, staged

#: Words in a shingle; bins of a signature by band and row.
WIDTH, BANDS, ROWS = 5, 32, 4
BINS = BANDS * ROWS
#: Two documents are linked if 100 * intersection >= LEAST * union.
LEAST = 75
#: Further stars.
STARS = 1
#: Texts in a batch, so that few long ones are in memory at a time.
BATCH = 500
#: A key with more than one in so many rows is hot.
HOT = 1000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of all its words if they are fewer; empty without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at the six ASCII blanks
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(WIDTH, len(found))
    out = np.full(len(found) - width + 1, width, np.uint64)
    for k in range(width):
        out = _scramble(out * _MIX + hashes[k : len(found) - width + 1 + k])
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of a set's densified signature."""
    mixed = _scramble(shingles + _MIX)
    bins = (mixed % np.uint64(BINS)).astype(np.int64)
    signature = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(signature, bins, mixed)
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    empty = np.flatnonzero(~filled)
    source, attempt = np.arange(BINS), np.uint64(0)
    while len(empty):
        attempt += np.uint64(1)
        tried = (_scramble(empty.astype(np.uint64) * _MIX + attempt) % np.uint64(BINS)).astype(np.int64)
        source[empty] = np.where(filled[tried], tried, source[empty])
        empty = empty[~filled[tried]]
    signature = signature[source].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _scramble(keys * _MIX + signature[:, k])
    return keys.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to the size, node and bucket keys of each text; node and keys are null and empty without words."""
    for batch in batches:
        sizes, nodes, keys = [], [], []
        for text in batch.column(2):
            found = shingle_set(text.as_py())
            sizes.append(len(found))
            nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63 if len(found) else None)
            keys.append(band_keys(found) if len(found) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), _lists(keys)], names=["doc_id", "text_hash", "n_shingles", "node", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a batch for each text: a set can be long
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), _lists([shingle_set(batch.column(1)[i].as_py()).view(np.int64)])], names=["node", "shingles"])


def _joined(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with their row of ``table``, which has one for a key and, in ``weight``, how many ``rows`` have it.

    Hot keys are joined by a broadcast: at most ``HOT`` keys can have so many of ``total`` rows. The others are shuffled.
    """
    hot = [r[0] for r in table.where(F.col(weight) * HOT > total).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    named = F.col(key).isin(hot)
    return rows.where(named).join(F.broadcast(table.where(named)), key).unionByName(rows.where(~named).join(table.where(~named), key))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for the nodes of ``links`` (a, b).

    Alternating large and small stars: each round links every larger neighbour of a node
    to the node's smallest one, then every smaller one, until nothing changes. Each
    round's links are staged; there are never more of them than at first.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * edges.count()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("links"))
        large = _joined(both, staged(least, "least"), "u", "links", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links"))
        small = _joined(large, staged(least, "least"), "u", "links", total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "stars")
        # Done once each node's smaller neighbour has none itself: every component is a star around its smallest node.
        if edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mixed(held: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, n and component of the buckets that have members in several components."""
    parts = held.where("members > 2").select("key", "node", "n").join(found, "node", "left")
    parts = parts.select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    several = parts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("held")).where("low < high")
    return staged(_joined(parts, staged(several.select("key", "held"), "mixed-keys"), "key", "held", held.count()), "mixed-buckets")


def _across(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs across components of ``rest`` (node, n, component) that share a rare shingle of both."""
    shingles = sets.join(rest, "node").select("node", "n", "component", F.explode("shingles").alias("shingle"))
    by_part = shingles.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("docs"))
    counts = by_part.groupBy("shingle").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("docs", "component")).alias("top"))
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("parts", "shingle"))
    ranked = shingles.join(counts, "shingle").withColumn("rank", rarest)
    least = F.ceil(F.col("n") * LEAST / 100)  # shingles that a similar set must share
    held = ranked.where((F.col("rank") <= F.col("n") - least + 1) & (F.col("parts") > 1))
    held = staged(held.select("shingle", "node", "n", "component", "rank", F.col("top.component").alias("largest")), "rare-shingles")
    # Of a shingle's classes, those of its largest component need no pairs among themselves. What
    # two sets share, from the rarest shared shingle on, must be enough: the shingles before it aren't shared.
    left, right = (held.select("shingle", "largest", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "component", "rank"))) for side in "ab")
    left, right = left.where("component_a <> largest"), right.drop("largest")
    fit = f"component_a <> component_b and (component_b = largest or node_a < node_b) and {100 + LEAST} * least(n_a - rank_a + 1, n_b - rank_b + 1) >= {LEAST} * (n_a + n_b)"
    pairs = left.join(right, "shingle").where(fit)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, with sizes na and nb) that are linked, by their full sets."""
    fit = pairs.where(100 * F.least("na", "nb") >= LEAST * F.greatest("na", "nb"))
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    known = fit.join(first, "a").join(second, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), shared.alias("shared"))
    return known.where(100 * F.col("shared") >= LEAST * (F.col("n") - F.col("shared"))).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing. A
    null doc_id is linked with nothing: component_id is null and it is kept. Rows that repeat a
    doc_id are one document, whose links are those of any of its texts; all of them get its
    component, each its own n_shingles. Empty tables give no rows; other columns are ignored.
    """
    found = _found(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row."""
    ship_by_value()
    with arrow_batches(docs.sparkSession, BATCH):
        return _near_duplicates(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))


def _near_duplicates(texts: DataFrame) -> DataFrame:
    signed = staged(texts.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, node long, keys array<long>"), "signatures")
    known = signed.where("doc_id is not null and node is not null")
    # The row that stands for a class is the one with the smallest id and text hash.
    classes = staged(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", F.struct("doc_id", "text_hash")).alias("text_hash"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = known.join(classes, ["node", "doc_id", "text_hash"]).dropDuplicates(["node"])
    members = staged(reps.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key")), "members")
    buckets = members.groupBy("key").agg(F.min_by(F.struct("node", "n"), "node").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    held = staged(_joined(members, staged(buckets, "hubs"), "key", "members", members.count()), "buckets")

    # The texts of classes that share a bucket are read once more, for their sets.
    near = held.select("node").distinct().join(classes, "node").select("node", "doc_id", "text_hash")
    sets = texts.join(near.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("node", "text").mapInArrow(_sets, "node long, shingles array<long>")
    sets = staged(sets.dropDuplicates(["node"]), "sets")

    star = held.where("node <> hub.node").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct()
    links = staged(_confirmed(star, sets), "star-links")
    found = components(links)
    for k in range(STARS):
        rest = _mixed(held, found)
        hubs = rest.groupBy("key").agg(F.min_by(F.struct("node", "n", "component"), F.xxhash64(F.lit(k), "key", "node")).alias("hub"), F.max("held").alias("held"))
        pairs = _joined(rest.drop("held"), staged(hubs, "hubs"), "key", "held", rest.count()).where("component <> hub.component")
        pairs = staged(pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct(), "stars")
        if pairs.isEmpty():
            break
        links = links.union(staged(_confirmed(pairs, sets), "star-links"))
        found = components(links)
    across = staged(_across(_mixed(held, found).select("node", "n", "component").distinct(), sets), "across")
    if not across.isEmpty():
        links = links.union(staged(_confirmed(across, sets), "across-links"))
        found = components(links)

    # Documents of different classes may share an id: their classes are one.
    shared = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    same = staged(known.join(shared, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct(), "same-ids")
    if not same.isEmpty():
        found = components(links.union(same))
    of = classes.join(found, "node", "left").select("node", "doc_id", "copies", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = staged(of.join(least, "component").select("node", "component_id", "copies"), "component-ids")
    for table in (members, held, sets):  # the result reads none of these
        discard(table)
    release(texts.sparkSession)
    named = _joined(known.select("node", "doc_id", "text_hash", "n_shingles"), of, "node", "copies", known.count()).drop("node", "copies")
    # What has no shingles is alone, but for rows whose doc_id has another text with some.
    blank = signed.where("doc_id is not null and node is null").select("doc_id", "text_hash", "n_shingles")
    blank = blank.join(named.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    blank = blank.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = signed.where("doc_id is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(blank).unionByName(nameless)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that ``near_duplicates`` keeps.

    Of rows that repeat both doc_id and text one stays; rows that share a doc_id but not the text are one document and all stay if
    it does. Rows with a null doc_id all stay.
    """
    kept = _found(docs).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    once = rows.join(kept.hint("shuffle_hash"), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return once.select("row.*").unionByName(docs.where("doc_id is null"))
