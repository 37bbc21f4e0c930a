"""The prefix trie of conversations, every node with its members, children, leaves and what sharing it saves.

1. Conversations are rebuilt: each starts with the first turns of the one that opens its hundred. A turn is
   128 bits of the hash of its role and text.
2. Conversations are dealt by range of their turn sequences (and id, so a sequence that many share is spread) and sorted.
3. A task cuts its rows into blocks. Each is a padded matrix of turn numbers, sorted by columns; where
   a column changes, all columns after it begin new nodes (an accumulated OR), and what nodes hold is reduced
   between these starts, depth by depth from the deepest.
4. Nodes on the path of a block's first or last row may go on in the next block. They leave the block as two rows, with
   what has been summed so far; these rows are dealt by range and put in blocks again, until one block holds all that are left.
5. A node is named by a chained 128-bit hash of its turns: so children find their parent's
   conversation if it was closed later than they, and nodes the digest of conversations that end there, which is made in one stream of sorted ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.neardup import _MIX, _joined, _scramble
from trialweave.session import ship_by_value, staged

#: Conversations of a hundred share an opening of up to so many turns less one.
SHARED, HUNDRED = 6, 100
#: Cells of a block's matrix, and rows that it has in any case; cells of a task.
CELLS, LEAST_ROWS, TASK = 500_000, 16, 2_000_000
_NONE = np.iinfo(np.int64).max
_VALUES = ("n", "conv", "children", "leaves", "saved", "size")
_OUT = "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key binary, parent_key binary, a array<long>, b array<long>, " + ", ".join(f"{v} array<long>" for v in _VALUES)
_TYPES = {"kind": pa.string(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "key": pa.binary(), "parent_key": pa.binary()} | {k: pa.list_(pa.int64()) for k in ("a", "b", *_VALUES)}


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (a and b, a hash, by turn) and size (code points by turn) of every rebuilt conversation.

    Turns are ordered by number, null first; those of one number by the hash of role and text. Null roles and texts are empty, and rows without conv_id are none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), F.length(text).cast("long").alias("size"))
    own = conversations.where("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["size"].alias("size"))).alias("own"))
    own = staged(own, "conversations")
    opening = own.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("of"), F.slice("own", 1, SHARED - 1).alias("opening"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    paired = own.withColumn("of", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(opening, "of", "left").withColumn("h", shared)
    first = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.array().cast(dict(own.dtypes)["own"]))
    turns = F.concat(first, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return paired.select("conv_id", turns.alias("turns"))


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 and up for each distinct (a, b), in their order."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def _binary(keys: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as 16 bytes."""
    keys = np.ascontiguousarray(keys)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _batch(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()], names=list(_TYPES))


def _spaced(flat: np.ndarray, sizes: np.ndarray, first: int, width: int, fill: int) -> np.ndarray:
    """Lists, one after another, as rows of a matrix that begin in column ``first``."""
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first] = flat
    return out


def block(a: list[np.ndarray], b: list[np.ndarray], values: dict[str, list[np.ndarray]], last: bool, ends: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The closed nodes of a block, its open ones as rows for the next level and, given the ids of its rows as ``ends``, the node where each ends.

    Row r has len(a[r]) turns, and each of ``values`` one number for each depth from 0 to that.
    """
    rows, length = len(a), np.array([len(x) for x in a])
    deep = int(length.max())
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort(np.vstack([np.zeros(rows), _spaced(_ranks(flat_a, flat_b), length, 0, max(deep, 1), 0).T[::-1]]))
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    turns = _spaced(_ranks(flat_a, flat_b), length, 1, deep + 1, 0)[order]
    keys = np.zeros((rows, deep + 1, 2), np.uint64)
    keys[:, 0] = [1, 2]
    for lane, flat in enumerate((flat_a, flat_b)):
        own = _spaced(flat, length, 1, deep + 1, 0)[order].view(np.uint64)
        for d in range(1, deep + 1):
            keys[:, d, lane] = _scramble(keys[:, d - 1, lane] * _MIX + own[:, d])
    held = {k: _spaced(np.concatenate(v), length + 1, 0, deep + 1, _NONE if k == "conv" else 0)[order] for k, v in values.items()}
    ids, length = None if ends is None else ends[order], length[order]
    changed = np.ones((rows, deep + 1), bool)
    changed[1:, 0] = False
    changed[1:, 1:] = turns[1:, 1:] != turns[:-1, 1:]
    starts = np.logical_or.accumulate(changed, axis=1) & (np.arange(deep + 1) <= length[:, None])
    node, at, found = np.full((rows, deep + 1), -1, np.int64), [], []
    for d in range(deep + 1):
        live = np.flatnonzero(length >= d)
        begins = starts[live, d]
        node[live, d] = np.cumsum(begins) - 1
        cut = np.flatnonzero(begins)
        at.append(live[cut])
        own = {k: np.add.reduceat(held[k][live, d], cut) for k in ("n", "children", "leaves", "saved")}
        own["conv"], own["size"] = np.minimum.reduceat(held["conv"][live, d], cut), np.maximum.reduceat(held["size"][live, d], cut)
        own["open"] = np.zeros(len(cut), bool)
        if not last:
            own["open"][[node[r, d] for r in (0, rows - 1) if length[r] >= d]] = True
        found.append(own)
    for d in range(deep, -1, -1):
        own = found[d]
        if d < deep:
            below, parent = found[d + 1], node[at[d + 1], d]
            closed = ~below["open"]
            own["children"] += np.bincount(parent[closed], minlength=len(own["n"]))
            for k in ("leaves", "saved"):
                np.add.at(own[k], parent[closed], below[k][closed])
        done = ~own["open"]
        own["leaves"] = np.where(done & (own["children"] == 0), 1, own["leaves"])
        own["saved"] = own["saved"] + np.where(done, (own["n"] - 1) * own["size"], 0)
    for d, own in enumerate(found):
        done = np.flatnonzero(~own["open"])
        if len(done):
            up = node[at[d][done], d - 1] if d else None
            known = ~found[d - 1]["open"][up] if d else np.zeros(len(done), bool)
            parents = pa.array(found[d - 1]["conv"][up] if d else np.zeros(len(done), np.int64), mask=~known)
            shown = {"n_convs": "n", "n_children": "children", "n_leaves": "leaves", "saved_tokens": "saved"}
            yield _batch(
                len(done), kind=pa.array(["node"] * len(done)), conv_id=pa.array(own["conv"][done]), depth=pa.array(np.full(len(done), d)), parent_conv_id=parents, key=_binary(keys[at[d][done], d]),
                parent_key=_binary(keys[at[d][done], d - 1]) if d else pa.nulls(len(done), pa.binary()), **{k: pa.array(own[v][done]) for k, v in shown.items()},
            )
    if not last:
        for r in dict.fromkeys((0, rows - 1)):
            # What the first and the last row share goes with the first.
            mine = [int(node[r, d]) if r == 0 or length[0] < d or node[r, d] != node[0, d] else -1 for d in range(length[r] + 1)]
            one = {k: pa.array([[int(found[d][k][m]) if m >= 0 else (_NONE if k == "conv" else 0) for d, m in enumerate(mine)]], pa.list_(pa.int64())) for k in _VALUES}
            yield _batch(1, kind=pa.array(["row"]), a=pa.array([a[order[r]]], pa.list_(pa.int64())), b=pa.array([b[order[r]]], pa.list_(pa.int64())), **one)
    if ids is not None:
        yield _batch(rows, kind=pa.array(["end"] * rows), conv_id=pa.array(ids), key=_binary(keys[np.arange(rows), length]))


def _blocks(last: bool, lowest: bool):
    """Sorted rows to blocks: (conv_id, a, b, size) of conversations at the lowest level, or (a, b, and values) of open rows."""

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if lowest:
            ids, a, b, sizes = (list(x) for x in zip(*held, strict=True))
            shape = [len(x) + 1 for x in a]
            zero = [np.zeros(n, np.int64) for n in shape]
            values = {"n": [np.ones(n, np.int64) for n in shape], "conv": [np.full(n, i, np.int64) for n, i in zip(shape, ids, strict=True)], "children": zero, "leaves": zero, "saved": zero, "size": [np.concatenate([[0], s]) for s in sizes]}
            yield from block(a, b, values, last, np.array(ids, np.int64))
        else:
            a, b, *rest = (list(x) for x in zip(*held, strict=True))
            yield from block(a, b, dict(zip(_VALUES, rest, strict=True)), last, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, widest = [], 0
        for batch in batches:
            lists = [[x.to_numpy() for x in _parts(c)] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for row in zip(*lists, strict=True):
                n = len(row[1]) + 1
                if not last and len(held) >= LEAST_ROWS and (len(held) + 1) * max(widest, n) > CELLS:
                    yield from made(held)
                    held, widest = [], 0
                held.append(row)
                widest = max(widest, n)
        if held:
            yield from made(held)

    return run


def _parts(column: pa.ListArray) -> Iterator[pa.Array]:
    flat, offsets = column.values, column.offsets.to_numpy()
    return (flat.slice(a, b - a) for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the ids of each key, from rows (key, conv_id) in order."""
    key, digest = None, hashlib.sha256()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for k, conv_id in zip(keys, batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield made()
                key, digest = k, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
    if key is not None:
        yield made()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``conversations`` (conv_id, turn, role, text).

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Ties of turn numbers are as in ``rebuilt``, and repeated rows are turns of their own. Without any conversation there is no node. Other columns
    are ignored. The turn hashes of one conversation must fit in a task; texts needn't.
    """
    ship_by_value()
    spark = conversations.sparkSession
    convs = rebuilt(conversations)
    rows = staged(convs.select("conv_id", "turns", "turns.a", "turns.b", "turns.size"), "rebuilt")
    levels: list[DataFrame] = []
    while True:
        cells, count = rows.agg(F.sum(F.size("a") + 1), F.count(F.lit(1))).first()
        lowest, last = not levels, not cells or (bool(levels) and count * 2 <= LEAST_ROWS) or cells <= CELLS // 4
        # Open rows are dealt so that tasks get many of them and each level has fewer, however long they are.
        parts = 1 if last else max(-(-cells // TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))) if lowest else max(1, min(-(-cells // TASK), count // (2 * LEAST_ROWS)))
        order = ["turns", "conv_id"] if lowest else ["turns"]
        columns = ["conv_id", "a", "b", "size"] if lowest else ["a", "b", *_VALUES]
        dealt = rows.coalesce(1) if last else rows.repartitionByRange(parts, *order)
        out = staged(dealt.sortWithinPartitions(*order).select(*columns).mapInArrow(_blocks(last, lowest), _OUT), "trie")
        levels.append(out)
        if last:
            break
        left = out.where("kind = 'row'").select("a", "b", *_VALUES)
        rows = left.withColumn("turns", F.arrays_zip("a", "b"))
    nodes = [x.where("kind = 'node'").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key", "parent_key") for x in levels]
    every, late = nodes[0], None
    for x in nodes[1:]:
        every, late = every.unionByName(x), x if late is None else late.unionByName(x)
    if late is not None:
        # Parents that were closed at a later level.
        asking = every.where("parent_conv_id is null and depth > 0").drop("parent_conv_id")
        wanted = asking.groupBy("parent_key").agg(F.count(F.lit(1)).alias("asked"))
        parents = staged(wanted.join(late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key"), "trie-parents")
        told = _joined(asking, parents, "parent_key", "asked", every.count()).drop("asked")
        every = every.where("parent_conv_id is not null or depth = 0").unionByName(told)
    ends = levels[0].where("kind = 'end'").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    digests = ends.mapInArrow(_digests, "key binary, ends_sha256 string")
    found = every.join(digests, "key", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
