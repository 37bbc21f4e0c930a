"""Line dedup by content-defined chunks.

A document's lines are hashed; a rolling polynomial hash over the hashes of the last two lines, modulo a prime, marks
candidate ends where ``EVERY`` divides it, and the first of adjacent candidates ends a
chunk. Ends depend on the lines around them alone, so chunks resynchronise after
insertions; only chunks of more than ``LONGEST`` lines (runs of equal lines, say) are cut by count. This is
done with several bases, and the chunks of all these chunkings count, for where one of them
has an end inside a short repeated passage another often has none. The first of them
joins a document's first or last line to its neighbours where it would be alone, so that whole copies leave no rest.

Of the chunks of two lines or more with the same bytes, in one document or many, the first by (doc_id, place)
stays and the others' lines are removed. Every removed line has an equal one earlier that stays.
Hashes only find candidates: chunks are the same if their texts are.

DataFrame functions only. Counts by hash are combined before the shuffle, so a
chunk that stands in most documents is no hot spot; texts are shuffled by document, and those
of chunks only where their hash repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import BLANK_CLASS, let
from trialweave.session import discard, release, staged

#: A base of the rolling hash for each chunking, its modulus, the share of lines that are candidates (1 / EVERY), and the most lines of a chunk.
BASES, MODULUS, EVERY, LONGEST = (1_000_003, 40_692_011, 715_225_739), 2**31 - 1, 2, 32


def line_hash(line: Column) -> Column:
    """28 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _ranges(hashes: Column, base: int, whole: bool) -> Column:
    """array of (first, n_lines): the chunks of one chunking; ``whole``: no line is alone at an edge."""

    def candidate(i: Column) -> Column:
        before = F.when(i > 0, F.get(hashes, i - 1)).otherwise(0)
        return (i >= 0) & (F.pmod(F.pmod(before * base + F.get(hashes, i), F.lit(MODULUS)), F.lit(EVERY)) == 0)

    n = F.size(hashes)
    inside = lambda i: ~i.isin(1, n - 1) if whole else F.lit(True)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (candidate(i - 1) & ~candidate(i - 2) & inside(i)))
    cut = lambda s: F.flatten(F.transform(s, lambda a, k: F.sequence(a, F.coalesce(F.get(s, k + 1), n) - 1, F.lit(LONGEST))))
    to = lambda s: F.transform(s, lambda a, k: F.struct(a.alias("first"), (F.coalesce(F.get(s, k + 1), n) - a).alias("n_lines")))
    return let(let(starts, cut), to)


def chunks(lines: Column) -> Column:
    """array of (first, n_lines): the distinct chunks of two lines or more of all chunkings."""
    found = let(F.transform(lines, line_hash), lambda h: F.concat(*(_ranges(h, base, base == BASES[0]) for base in BASES)))
    return F.filter(F.array_distinct(found), lambda c: c["n_lines"] > 1)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _chunk(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["first"] + 1, c["n_lines"]), "\n")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the array ``removed`` of a document's chunks (first, n_lines) that stand earlier."""
    hashed = let(_lines(F.col("text")), lambda x: F.transform(chunks(x), lambda c: F.struct(F.xxhash64(_chunk(x, c)).alias("hash"), c["first"].alias("first"), c["n_lines"].alias("n_lines"))))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = staged(keyed.select("doc_id", "text_hash", F.explode(hashed).alias("c")).select("doc_id", "text_hash", "c.*"), "line-hashes")
    again = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    candidates = rows.join(again, "hash").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n_lines")).alias("cs"))
    candidates = staged(candidates.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"}), "line-candidates")

    same = keyed["doc_id"].eqNullSafe(candidates["_doc"]) & (keyed["text_hash"] == candidates["_hash"])
    with_text = let(_lines(F.col("text")), lambda x: F.transform("cs", lambda c: F.struct(c["first"].alias("first"), c["n_lines"].alias("n_lines"), _chunk(x, c).alias("chunk"))))
    found = keyed.join(candidates.hint("shuffle_hash"), same).select("doc_id", "text_hash", F.explode(with_text).alias("c")).select("doc_id", "text_hash", "c.*")
    found = staged(found.where(F.col("chunk").rlike(f"[^{BLANK_CLASS}]")).withColumn("hash", F.xxhash64("chunk")), "line-chunks")
    release(docs.sparkSession)
    place = F.struct("doc_id", "text_hash", "first", "n_lines")
    first = staged(found.groupBy("hash", "chunk").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-firsts")
    later = found.join(first, ["hash", "chunk"]).where(place != F.col("earliest"))
    gone = staged(later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n_lines")).alias("removed")), "line-removed")
    for table in (rows, candidates, found, first):
        discard(table)
    release(docs.sparkSession)
    return gone


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated chunks removed from the texts.

    All rows and columns stay, with these added: n_lines, n_chunks (of two lines or more, of all chunkings), n_removed_chunks and
    n_removed_lines; columns of those names are replaced. A null text has no chunks and stays null; a text that
    loses all its lines becomes empty. Rows that repeat doc_id and text count as
    one document: they get the same result, and none is a copy of another. A null
    doc_id comes before all others. An empty table gives no rows. Chunks
    without a word stay, and so do repeated single lines.
    """
    gone = repeated_chunks(docs).select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash"), "removed")
    added = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    same = keyed["id"].eqNullSafe(gone["doc"]) & (keyed["text_hash"] == gone["hash"])
    joined = keyed.join(gone.hint("shuffle_hash"), same, "left")
    removed = F.coalesce(F.col("removed"), F.array().cast("array<struct<first:int,n_lines:int>>"))

    def left(lines: Column) -> Column:
        places = F.array_distinct(F.flatten(F.transform(removed, lambda c: F.sequence(c["first"], c["first"] + c["n_lines"] - 1))))

        def without(gone: Column) -> Column:
            stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            text = F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")
            return F.struct(text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(chunks(lines)).cast("long").alias("n_chunks"), F.size(removed).cast("long").alias("n_removed_chunks"), F.size(gone).cast("long").alias("n_removed_lines"))

        return let(places, without)

    was = F.col("row.text")
    out = joined.select("row", let(_lines(was), left).alias("left"))
    text = F.when(was.isNotNull() & (F.col("left.n_removed_chunks") > 0), F.col("left.text")).otherwise(was)
    counts = (F.when(was.isNotNull(), F.col(f"left.{c}")).otherwise(F.lit(0).cast("long")).alias(c) for c in added)
    return out.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in added), *counts)
