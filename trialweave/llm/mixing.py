"""Mixing sources to target weights.

Each source's documents stand in an order permuted by a keyed digest; the mix
takes the first words of that order, up to the source's target, and starts over
where the target exceeds the source. The order is cut into blocks of equal
numbers of words, so a target is an exact quota of blocks. A binary tree splits
the quotas of all sources among the output shards: at each node half of the node's blocks, drawn
without replacement by a digest, go left, which makes its
counts by source multivariate hypergeometric. A shard then owns disjoint runs of
each source's permuted blocks, and is shuffled locally.

Only DataFrame functions are used. Running totals over a source go by cells of
about ``CELL`` documents, so a source with most rows is no hot spot; the tree
works on one row for each block, of which there are ``BLOCKS_PER_SHARD`` for each shard and one more for
each source at most, never on documents.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import BLANK_CLASS, n_words
from trialweave.session import staged

#: Source weights in code-point order, null last, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most copies of a source.
SHARE, MOST = 1.5, 2
SHARDS, BLOCKS_PER_SHARD, CELL, SEED = 16, 64, 256, 17
#: Words in a part of a shard that one task shuffles.
SLICE = 4_000_000
#: Tasks that the mix is written by at most; each takes slices of one shard.
TASKS = 20_000
#: Digests have so many bits.
BITS = 60


def digest(*parts: Column | str) -> Column:
    """A 60-bit digest of ``parts``, that SQL can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))), 1, BITS // 4), 16, 10).cast("long")


def permutation_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A keyed digest of a document's id, or of its text if it has none."""
    return digest(str(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))))


def _sources(sized: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """One row per source: rank, n, source_size, target (words, exact) and quota (whole words).

    Targets fill up by weight to a common level; sources at their cap drop out of the
    sharing. With sources in order of cap over weight, those at their cap come first, so
    running sums give the level.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    found = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    found = found.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", weight.cast("double"))
    found = found.withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = F.sum("cap").over(by_ratio) - F.col("cap")
    after = F.sum("w").over(everything) - (F.sum("w").over(by_ratio) - F.col("w"))
    found = found.withColumn("level", (share * F.sum("source_size").over(everything) - before) / after)
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return found.withColumn("target", target).withColumn("quota", F.floor("target")).select("source", "rank", "n", "source_size", "target", "quota")


def shard_quotas(sources: DataFrame, shards: int, block_words: int, seed: int = SEED) -> DataFrame:
    """rank, shard and blocks: how many blocks of each source every shard gets.

    At a node of n blocks the floor(n / 2) with the least digests of (seed, node, source, block)
    go left, the others right. The blocks of a source that meet in a node are equal, so they are numbered anew there.
    """
    blocks = F.ceil(F.col("quota") / block_words)
    nodes = sources.select("rank", F.lit(1).cast("long").alias("node"), blocks.alias("blocks"))
    for _ in range(ceil(log2(shards))):
        each = nodes.where("blocks > 0").select("rank", "node", F.explode(F.sequence(F.lit(1).cast("long"), "blocks")).alias("block"))
        inside = Window.partitionBy("node")
        drawn = F.row_number().over(inside.orderBy(digest(str(seed), F.col("node"), F.col("rank"), F.col("block")), "rank", "block"))
        right = (drawn > F.floor(F.count(F.lit(1)).over(inside) / 2)).cast("long")
        nodes = each.withColumn("node", 2 * F.col("node") + right).groupBy("rank", "node").agg(F.count(F.lit(1)).alias("blocks"))
    return nodes.select("rank", (F.col("node") - 2 ** ceil(log2(shards))).cast("int").alias("shard"), "blocks")


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's columns, but for maps, which have none."""
    return F.xxhash64(*(f.name for f in docs.schema if not f.dataType.simpleString().startswith("map")))


def draws(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): what the mix takes of it.

    Returns doc_id, row (a hash of all columns), source, size, permutation (key), source_size, target and draws, an array of
    (copy, block, shard, words): a document is taken up to twice, and only the one at
    a source's end in part, by its leading words; it belongs to the block in which it begins. ``shards`` is a power of two. Null text has
    size 0; null source is a source; rows that repeat a doc_id are documents of
    their own; an empty table gives no rows. Sources and blocks are small
    tables: one row per source, and shards * 64 blocks plus one per source.
    """
    sized = docs.select("doc_id", row_hash(docs).alias("row"), "source", n_words(F.col("text")).alias("size"), permutation_key(F.col("doc_id"), F.col("text"), seed).alias("permutation"))
    sized = staged(sized, "mix-sizes")
    sources = staged(_sources(sized, weights, share), "mix-sources")
    block_words = max(1, ceil((sources.agg(F.sum("quota")).first()[0] or 0) / (shards * BLOCKS_PER_SHARD)))

    cell = F.floor(F.col("permutation") / float(2**BITS) * F.ceil(F.col("n") / CELL))
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("cell", cell)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("rank", "cell").agg(F.sum("size").alias("words")).withColumn("part", F.floor(F.col("cell") / 4096))
    parts = cells.groupBy("rank", "part").agg(F.sum("words").alias("words"))
    parts = parts.select("rank", "part", F.coalesce(F.sum("words").over(before(Window.partitionBy("rank").orderBy("part"))), F.lit(0)).alias("part_start"))
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("words").over(before(Window.partitionBy("rank", "part").orderBy("cell"))), F.lit(0)))
    starts = staged(cells.join(parts, ["rank", "part"]).select("rank", "cell", (F.col("part_start") + F.col("cell_start")).alias("start")), "mix-cells")
    inside = F.coalesce(F.sum("size").over(before(Window.partitionBy("rank", "cell").orderBy("permutation", "doc_id", "size", "row"))), F.lit(0))
    placed = rows.withColumn("inside", inside).join(starts, ["rank", "cell"]).withColumn("start", F.col("start") + F.col("inside"))

    owned = shard_quotas(sources, shards, block_words, seed)
    first = F.coalesce(F.sum("blocks").over(before(Window.partitionBy("rank").orderBy("shard"))), F.lit(0))
    owned = owned.withColumn("first", first).where("blocks > 0")
    blocks = staged(owned.select("rank", "shard", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block")), "mix-blocks")
    for copy in range(MOST):
        at = F.col("start") + copy * F.col("source_size")
        mine = blocks.select("rank", F.col("block").alias(f"block{copy}"), F.col("shard").alias(f"shard{copy}"))
        placed = placed.withColumn(f"words{copy}", F.greatest(F.least(F.col("quota") - at, F.col("size")), F.lit(0)))
        placed = placed.withColumn(f"block{copy}", F.when(F.col(f"words{copy}") > 0, F.floor(at / block_words))).join(mine, ["rank", f"block{copy}"], "left")
    each = [F.when(F.col(f"shard{c}").isNotNull(), F.struct(F.lit(c).alias("copy"), F.col(f"block{c}").alias("block"), F.col(f"shard{c}").alias("shard"), F.col(f"words{c}").alias("words"))) for c in range(MOST)]
    return placed.select("doc_id", "row", "source", "size", "permutation", "source_size", "target", F.filter(F.array(*each), lambda x: x.isNotNull()).alias("draws"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and drawn for every row; see ``draws`` for the cases.

    ``drawn`` tells for each copy which shard and which of its source's blocks it went to, and with how many words: "shard/block/words", joined by spaces.
    """
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    drawn = F.array_join(F.transform("draws", lambda d: F.concat_ws("/", d["shard"].cast("string"), d["block"].cast("string"), d["words"].cast("string"))), " ")
    return draws(docs, **how).select("doc_id", "size", "source_size", "target", taken.alias("taken"), drawn.alias("drawn"))


def mix(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, **how) -> DataFrame:
    """The mixed rows themselves: every column of ``docs`` for each draw, each shard in partitions of its own and shuffled.

    A document drawn twice stands twice; one drawn in part keeps its leading
    words. Texts that are null or blank have no words to draw and go. Equal rows are one row with the draws of all.
    """
    drawn = draws(docs, shards=shards, seed=seed, **how).select("doc_id", "row", "size", F.explode("draws").alias("draw"))
    drawn = staged(drawn.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("size").alias("_size"), "draw"), "mix-draws")
    slices = max(1, ceil((drawn.agg(F.sum("draw.words")).first()[0] or 0) / shards / SLICE))
    # Equal rows are combined before the shuffle that the join needs anyway.
    rows = docs.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), row_hash(docs).alias("_hash")).agg(F.first(F.struct(*docs.columns)).alias("row"))
    same = (rows["_id"] == F.coalesce(drawn["_doc"], F.lit(0))) & (rows["_hash"] == drawn["_row"])
    found = drawn.join(rows.hint("shuffle_hash"), same)
    shuffled = digest(str(seed), F.col("draw.shard"), F.col("draw.copy"), F.col("_doc"), F.col("_row"))
    ended = F.split(F.col("row.text"), f"(?<=[^{BLANK_CLASS}])(?=[{BLANK_CLASS}])")
    leading = F.array_join(F.slice(ended, F.lit(1), F.col("draw.words").cast("int")), "")
    text = F.when(F.col("draw.words") < F.col("_size"), leading).otherwise(F.col("row.text"))
    out = found.withColumn("text", text).withColumn("at", shuffled).withColumn("part", (F.col("draw.shard") * slices + F.floor(F.col("at") / float(2**BITS) * slices)).cast("int"))
    each = max(1, min(slices, TASKS // shards))  # tasks of a shard
    task = F.floor(F.col("part") / slices) * each + F.floor(F.pmod("part", F.lit(slices)) * each / slices)
    out = out.repartitionById(shards * each, task.cast("int")).sortWithinPartitions("part", "at")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
