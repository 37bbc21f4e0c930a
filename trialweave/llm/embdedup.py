"""Near-duplicate vectors by robust-pruned flat graphs.

Vectors are compared within a label (and a number of components) by cosine, in double precision.

1. Equal vectors of a label form a class (``node``), so copies cost nothing.
2. Each label is split into overlapping cells by spherical k-means, level by level, until
   a cell has at most ``SHARD`` classes. Centroids are fitted on about ``SAMPLE`` classes of a cell; all classes
   are dealt. A class goes to its nearest centroid's cell and to every other whose bisector
   with that one is within ``margin``. Linked vectors are at most ``CHORD`` apart, so
   at a margin of ``CHORD / 2`` any two of them meet in some cell; smaller margins
   are tried first, and the audit says whether they do.
3. In each cell a graph is built: the ``NEAR`` nearest of each node, robustly pruned, and the reverse
   edges. The lists that a node has from several cells are united.
4. Every node is a query: a greedy search from the cell's medoids, with a beam of ``BEAM``, until it comes upon
   the query's own node; then its range is expanded through all nodes that are in it. A search that
   ends without finding its own node has failed, and the cell is scanned for it in blocks.
5. Found pairs are verified in double precision and counted in the least cell that both have; what leaves a cell is a row for
   each node, with its count and the root of its component within the cell.
6. The audit: ``AUDIT`` classes are compared with all classes. If fewer than ``RECALL`` of their links were found, the next margin is taken.

Dense groups: where a centroid has more than ``SHARD / 2`` classes within half the linking angle (estimated from
the sample), these form a ball, in which all are linked with all others by the triangle inequality, so none is compared with another. Classes
near a ball are its guests and are compared with its members, in parts of ``PART`` members. A cell that margins
keep from shrinking (what its children would hold, by the sample, is no less work), or that is larger than ``SHARD`` after ``LEVELS`` levels,
is compared whole, in such parts too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.neardup import _joined, components
from trialweave.session import ship_by_value, staged

#: Two vectors are linked from this cosine up.
LEAST = 0.93
#: Distance of unit vectors at that cosine; cosines of half the linking angle, and of one and a half times it (a guest of a ball).
CHORD = float(np.sqrt(2 - 2 * LEAST))
HALF, GUEST = float(np.cos(np.arccos(LEAST) / 2)) + 1e-7, float(np.cos(np.arccos(LEAST) * 1.5)) - 1e-6
#: Classes in a cell, in the sample that its centroids are fitted on, and in a part; levels of cells; most children of a cell.
SHARD, SAMPLE, PART, LEVELS, CHILDREN = 4000, 4000, 2000, 8, 64
#: Candidates and edges of a node, edges with the reverse ones, slack of the pruning, beam, medoids of a cell, nodes expanded at a time, queries searched at once.
NEAR, EDGES, DEGREE, SLACK, BEAM, MEDOIDS, WIDE, QUERIES = 48, 24, 48, 1.2, 32, 32, 4, 256
#: Audited classes, the share of their links to be found, and margins.
AUDIT, RECALL, MARGINS = 512, 0.995, (0.06, 0.12, CHORD / 2 + 1e-6)
#: Roles of a row of a cell: it is compared with all others; it is a ball's member; it is a ball's guest.
OPEN, MEMBER, VISITOR = 0, 1, 2

_ROWS = "node long, cell string, role int, copies long, v array<float>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _units(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _vectors(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * (v.shape[1] if len(v) else 0)), pa.array(v.reshape(-1).astype(np.float32)))


def centroids(units: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from rows spread over the input; the centroid with most rows comes first."""
    k = min(k, len(units))
    at = units[np.random.default_rng(len(units)).permutation(len(units))[:k]]
    for _ in range(rounds):
        own = (units @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, units)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        at = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), at)
    return at[np.argsort(-np.bincount((units @ at.T).argmax(axis=1), minlength=k), kind="stable")]


def _near(cosines: np.ndarray, at: np.ndarray, margin: float) -> np.ndarray:
    """Which centroids' cells each row goes to: the nearest, and those behind a bisector within ``margin``."""
    best = cosines.argmax(axis=1)
    apart = np.sqrt(np.maximum(((at[:, None] - at[None]) ** 2).sum(axis=2), 1e-18))
    goes = (cosines.max(axis=1, keepdims=True) - cosines) <= margin * apart[best]
    goes[np.arange(len(best)), best] = True
    return goes


def _fitted(margin: float):
    def fit(table: pa.Table) -> pa.Table:
        """The centroids of a cell, from its sample, which of them have a ball, and whether all else had better stay together."""
        units, n = _units(_matrix(table["v"])), table["n"][0].as_py()
        at = centroids(units, min(CHILDREN, max(2, -(-2 * n // SHARD))))
        cosines = units @ at.T
        ball = (cosines >= HALF).mean(axis=0) * n > SHARD / 2
        goes = _near(cosines, at, margin)[~(cosines >= HALF)[:, ball].any(axis=1)]
        # Children so large, visited by so many, would be no less work than the whole.
        whole = not len(goes) or goes.sum(axis=1).mean() * goes.mean(axis=0).max() >= 1
        return pa.table({"cell": [table["cell"][0].as_py()], "ball": [ball.tolist()], "whole": [bool(whole)], "v": _vectors(at.reshape(1, -1))})

    return fit


def _dealt(margin: float):
    def deal(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not rows.num_rows or not fitted.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "cell": pa.array([], pa.string()), "role": pa.array([], pa.int32()), "copies": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float32()))})
        v, ball, cell = _matrix(rows["v"]), np.array(fitted["ball"][0].as_py()), fitted["cell"][0].as_py()
        units = _units(v)
        at = _matrix(fitted["v"]).reshape(len(ball), -1).astype(np.float64)
        cosines = units @ at.T
        # The first ball that holds a row has it as a member; it is a guest of the other balls near it.
        held = (cosines >= HALF) & ball
        of = np.where(held.any(axis=1), held.argmax(axis=1), -1)
        visits = (cosines >= GUEST) & ball
        visits[np.arange(len(of)), of] &= of < 0
        goes = _near(cosines, at, margin)
        if fitted["whole"][0].as_py():
            goes[:] = np.arange(len(ball)) == 0
        goes[of >= 0] = False
        out = [(np.flatnonzero(of >= 0), of[of >= 0], MEMBER, "b"), (*np.nonzero(visits), VISITOR, "b"), (*np.nonzero(goes), OPEN, "")]
        i = np.concatenate([x[0] for x in out])
        cells = [f"{cell}.{kind}{j}" for _, js, _, kind in out for j in js]
        roles = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in out])
        return pa.table({"node": rows["node"].to_numpy()[i], "cell": pa.array(cells, pa.string()), "role": roles, "copies": rows["copies"].to_numpy()[i], "v": _vectors(v[i])})

    return deal


def _cells(rows: DataFrame, margin: float) -> DataFrame:
    """Rows (node, cell, role, copies, v) of all cells and balls. ``rows`` has the same columns, with a cell for each label."""
    done: DataFrame | None = None
    for _ in range(LEVELS):
        sizes = staged(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
        if sizes.where(F.col("n") > SHARD).isEmpty():
            break
        sized = _joined(rows, sizes, "cell", "n", rows.count())
        sample = sized.where((F.col("n") > SHARD) & (F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / SAMPLE)) == 0))
        fitted = staged(sample.groupBy("cell").applyInArrow(_fitted(margin), "cell string, ball array<boolean>, whole boolean, v array<float>"), "centroids")
        split = fitted.where(~F.col("whole") | F.exists("ball", lambda x: x)).join(sizes, "cell")
        splits = staged(sizes.join(split.select("cell", F.lit(True).alias("splits")), "cell", "left").withColumn("splits", F.col("splits").isNotNull()), "cell-splits")
        sized = _joined(rows, splits, "cell", "n", rows.count())
        kept = sized.where(~F.col("splits")).drop("n", "splits")
        parts = F.ceil(F.col("n") / PART).cast("int")
        dealt = sized.where("splits").withColumn("part", F.pmod(F.xxhash64("node", F.lit(8)), parts).cast("int")).drop("n", "splits")
        each = split.select("cell", "ball", "whole", "v", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        found = staged(dealt.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInArrow(_dealt(margin), _ROWS), "cells")
        kept = kept.unionByName(found.where(F.col("role") != OPEN))
        done = kept if done is None else done.unionByName(kept)
        rows = found.where(F.col("role") == OPEN)
    return staged(rows if done is None else done.unionByName(rows), "cell-rows")


def pruned(units: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of a robustly pruned graph with its reverse edges: of two candidates, one that is much nearer to the other than to the node goes."""
    n, k = len(units), min(NEAR, len(units) - 1)
    src, dst = [], []
    for a in range(0, n if k else 0, block):
        q = units[a : a + block]
        cosines = q @ units.T
        cosines[np.arange(len(q)), np.arange(a, a + len(q))] = -2
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(cosines, near, axis=1)
        order = np.argsort(-own, axis=1)
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        between = np.matmul(units[near], units[near].transpose(0, 2, 1))
        # Squared distances are 2 - 2 * cosine.
        left, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for j in range(k):
            take = left[:, j] & (kept.sum(axis=1) < EDGES)
            kept[:, j] = take
            left &= ~(take[:, None] & (SLACK * SLACK * (1 - between[:, j]) <= 1 - own))
        i, j = np.nonzero(kept)
        src.append(i + a)
        dst.append(near[i, j])
    if not src:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s, d = np.concatenate(src), np.concatenate(dst)
    return np.concatenate([s, d]), np.concatenate([d, s])


def _lists(units: np.ndarray, src: np.ndarray, dst: np.ndarray, most: int | None) -> np.ndarray:
    """Edges as rows of neighbours, nearest first, filled up with -1."""
    both = np.unique(src * len(units) + dst)
    src, dst = both // len(units), both % len(units)
    order = np.lexsort((-np.einsum("ij,ij->i", units[src], units[dst]), src))
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(len(units)))
    place = np.arange(len(src)) - first[src]
    width = max(1, int(place.max(initial=0)) + 1)
    width = min(width, most) if most else width
    out = np.full((len(units), width), -1, np.int64)
    fit = place < width
    out[src[fit], place[fit]] = dst[fit]
    return out


def _built(table: pa.Table) -> pa.Table:
    """A cell's graph: each node's neighbours."""
    node, units = table["node"].to_numpy(), _units(_matrix(table["v"])).astype(np.float32)
    near = _lists(units, *pruned(units), DEGREE)
    return pa.table({"node": node, "near": pa.array([node[x[x >= 0]] for x in near], pa.list_(pa.int64()))})


def search(units: np.ndarray, near: np.ndarray, medoids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes ``queries``: (position of the query, node) of all nodes found in range, and whether each search found its own node."""
    n, b, least = len(units), len(queries), LEAST - 1e-4
    q, rows = units[queries], np.arange(b)
    seen, ended = np.zeros((b, n), bool), np.zeros(b, bool)
    beam = np.full((b, BEAM), -1, np.int64)
    score, fresh = np.full((b, BEAM), -9.0, np.float32), np.zeros((b, BEAM), bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(who: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that queries come upon, (len(who), m), with the cosines of new ones; others have -9."""
        to = np.sort(to, axis=1)
        new = (to >= 0) & ~seen[who[:, None], to]
        new[:, 1:] &= to[:, 1:] != to[:, :-1]
        i, j = np.nonzero(new)
        seen[who[i], to[i, j]] = True
        cosines = np.full(to.shape, -9.0, np.float32)
        cosines[i, j] = np.einsum("ij,ij->i", units[to[i, j]], q[who[i]])
        found = cosines[i, j] >= least
        hits.append((who[i[found]], to[i[found], j[found]]))
        ended[who[(to == queries[who][:, None]).any(axis=1)]] = True
        return to, cosines

    who, to = rows, np.broadcast_to(medoids, (b, len(medoids)))
    while len(who):
        to, cosines = meet(who, to)
        all_to, all_score = np.concatenate([beam[who], to], axis=1), np.concatenate([score[who], cosines], axis=1)
        all_fresh = np.concatenate([fresh[who], cosines > -9], axis=1)
        top = np.argpartition(-all_score, BEAM - 1, axis=1)[:, :BEAM]
        beam[who], score[who], fresh[who] = (np.take_along_axis(x, top, axis=1) for x in (all_to, all_score, all_fresh))
        who = rows[~ended & fresh.any(axis=1)]
        wanted = np.where(fresh[who], score[who], -9.0)
        pick = np.argpartition(-wanted, WIDE - 1, axis=1)[:, :WIDE]
        chosen = np.where(np.take_along_axis(wanted, pick, axis=1) > -9, np.take_along_axis(beam[who], pick, axis=1), -1)
        fresh[who[:, None], pick] = False
        to = np.where(chosen[:, :, None] >= 0, near[chosen], -1).reshape(len(who), WIDE * near.shape[1])
    # Range expansion: through every node in range, until no new one is met.
    found, front = [], hits.copy()
    while front:
        who, at = (np.concatenate([x[k] for x in front]) for k in (0, 1))
        found.append((who, at))
        front = []
        for a in range(0, len(who), 4096):
            w, to = who[a : a + 4096], near[at[a : a + 4096]]
            i, j = np.nonzero((to >= 0) & ~seen[w[:, None], to])
            key = np.unique(w[i] * n + to[i, j])
            w, to = key // n, key % n
            seen[w, to] = True
            inside = np.einsum("ij,ij->i", units[to], q[w]) >= least
            if inside.any():
                front.append((w[inside], to[inside]))
    who, at = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else (np.empty(0, np.int64),) * 2
    return who, at, ended


def _hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least node of each one's component, after the links (a, b)."""
    while len(a) and (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    return root


def _shared(cells: list[list[str]], roles: list[list[int]]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Each row's cells as numbers in order of name, filled up with -1, and where it is a guest."""
    number = {c: k for k, c in enumerate(sorted({c for x in cells for c in x}))}
    width = max(map(len, cells))
    held, guest = np.full((len(cells), width), -1, np.int64), np.zeros((len(cells), width), bool)
    for i, (names, own) in enumerate(zip(cells, roles, strict=True)):
        held[i, : len(names)] = [number[c] for c in names]
        guest[i, : len(own)] = [r == VISITOR for r in own]
    return held, guest, number


def _owned(held: np.ndarray, guest: np.ndarray, here: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether ``here`` is the least cell in which both of a pair are, and not both as guests."""
    a, b = held[i], held[j]
    both = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0) & ~(guest[i][:, :, None] & guest[j][:, None, :])
    return np.where(both, a[:, :, None], 1 << 60).min(axis=(1, 2)) == here


def _linked(exact: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are linked, in double precision."""
    return np.concatenate([np.einsum("ij,ij->i", exact[i[a : a + 65536]], exact[j[a : a + 65536]]) >= LEAST for a in range(0, len(i), 65536)]) if len(i) else np.empty(0, bool)


def _searched(table: pa.Table) -> pa.Table:
    """A cell's rows (node, cell, copies, v, cells, roles, near): each node's count of links owned here, and its root."""
    order = np.argsort(table["node"].to_numpy())
    node, copies, exact = table["node"].to_numpy()[order], table["copies"].to_numpy()[order], _units(_matrix(table["v"]))[order]
    units, n = exact.astype(np.float32), len(node)
    lists = table["near"].combine_chunks().take(pa.array(order))
    src, dst = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(node, dst), n - 1)
    near = _lists(units, src[node[at] == dst], at[node[at] == dst], None)  # neighbours from other cells that are in this one
    middle = centroids(exact, MEDOIDS, 3).astype(np.float32)
    medoids = np.unique((middle @ units.T).argmax(axis=1))
    pairs = []
    for a in range(0, n, QUERIES):
        queries = np.arange(a, min(n, a + QUERIES))
        who, to, ended = search(units, near, medoids, queries)
        missed = np.flatnonzero(~ended)
        i, j = np.nonzero(units[queries[missed]] @ units.T >= LEAST - 1e-4)
        who, to = np.concatenate([queries[who], queries[missed[i]]]), np.concatenate([to, j])
        apart = who != to
        pairs.append(np.unique(np.minimum(who, to)[apart] * n + np.maximum(who, to)[apart]))
    both = np.unique(np.concatenate(pairs))
    i, j = both // n, both % n
    fit = _linked(exact, i, j)
    i, j = i[fit], j[fit]
    held, guest, number = _shared(table["cells"].take(pa.array(order)).to_pylist(), table["roles"].take(pa.array(order)).to_pylist())
    own, counts = _owned(held, guest, number[table["cell"][0].as_py()], i, j), np.zeros(n, np.int64)
    np.add.at(counts, i[own], copies[j[own]])
    np.add.at(counts, j[own], copies[i[own]])
    return pa.table({"node": node, "n": counts, "root": node[_hooked(np.arange(n), i, j)]})


def _compared(table: pa.Table) -> pa.Table:
    """A part (inside) of a ball or of a large cell and all that is compared with it: counts and roots, by blocks.

    In a ball guests meet members, and both get counts. In a large cell all rows meet all parts, and those that meet a part get counts.
    """
    inside, node, copies, exact = (table["inside"].to_numpy(zero_copy_only=False), table["node"].to_numpy(), table["copies"].to_numpy(), _units(_matrix(table["v"])))
    held, guest, number = _shared(table["cells"].to_pylist(), table["roles"].to_pylist())
    here, ball = number[table["cell"][0].as_py()], table["ball"][0].as_py()
    members, others = np.flatnonzero(inside), np.flatnonzero(~inside)
    places = np.unique(node)
    local = np.searchsorted(places, node)
    root, counts = np.arange(len(places)), np.zeros(len(places), np.int64)
    for a in range(0, len(others), 512):
        block = others[a : a + 512]
        i, j = np.nonzero(exact[block] @ exact[members].T >= LEAST - 1e-9)
        i, j = block[i], members[j]
        fit = _linked(exact, i, j) & (node[i] != node[j])
        i, j = i[fit], j[fit]
        root = _hooked(root, local[i], local[j])
        own = _owned(held, guest, here, i, j)
        np.add.at(counts, local[i[own]], copies[j[own]])
        if ball:
            np.add.at(counts, local[j[own]], copies[i[own]])
    return pa.table({"node": places, "n": counts, "root": places[root]})


def _found(rows: DataFrame) -> DataFrame:
    """node, n (links to others, of different classes) and root, in several rows for a node; ``rows`` are those of ``_cells``."""
    lists = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("cell", "role"))).alias("in"))
    held = rows.join(lists, "node").select("node", "cell", "role", "copies", "v", F.col("in.cell").alias("cells"), F.col("in.role").alias("roles"))
    sizes = staged(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("role") != OPEN).alias("ball"), F.count_if(F.col("role") == MEMBER).alias("members"), F.min(F.when(F.col("role") == MEMBER, F.col("node"))).alias("least")), "cell-sizes")
    held = staged(_joined(held, sizes, "cell", "rows", rows.count()), "cell-members")
    small = held.where(~F.col("ball") & (F.col("rows") <= SHARD))
    graph = small.groupBy("cell").applyInArrow(_built, "node long, near array<long>")
    united = staged(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    out = small.select("node", "cell", "copies", "v", "cells", "roles").join(united, "node").groupBy("cell").applyInArrow(_searched, "node long, n long, root long")
    if held.where(F.col("ball") | (F.col("rows") > SHARD)).isEmpty():
        return out
    # Two members of a ball may meet in another cell too. Members with the same cells and roles are counted together, and pairs of such kinds where the ball is their least common cell.
    members = held.where(F.col("role") == MEMBER).withColumn("kind", F.md5(F.to_json(F.struct("cell", "cells", "roles"))))
    kinds = staged(members.groupBy("kind", "cell", "cells", "roles").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")), "member-kinds")
    kinds = kinds.select("kind", "cell", "cells", "all", "rows", F.filter("cells", lambda c, i: F.get("roles", i) != VISITOR).alias("own"))
    other = kinds.select("cell", F.col("cells").alias("cells_b"), F.col("own").alias("own_b"), F.col("all").alias("all_b"))
    met = F.array_min(F.array_union(F.array_intersect("cells", "own_b"), F.array_intersect("own", "cells_b")))
    owned = kinds.join(other, "cell").groupBy("kind", "rows").agg(F.sum(F.when(met == F.col("cell"), F.col("all_b")).otherwise(0)).alias("owned"), F.max((met == F.col("cell")) & (F.col("cells") == F.col("cells_b"))).alias("self"))
    clique = _joined(members.drop("rows"), staged(owned, "owned-kinds"), "kind", "rows", members.count()).select("node", (F.col("owned") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("n"), F.col("least").alias("root"))
    large = held.where(F.col("ball") | (F.col("rows") > SHARD))
    parts = F.ceil(F.when(F.col("ball"), F.col("members")).otherwise(F.col("rows")) / PART).cast("int")
    columns = ("node", "cell", "ball", "copies", "v", "cells", "roles", "part")
    inner = large.where(F.col("role") != VISITOR).withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), parts).cast("int")).select(*columns, F.lit(True).alias("inside"))
    outer = large.where(F.col("role") != MEMBER).where(parts > 0).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*columns, F.lit(False).alias("inside"))
    compared = inner.unionByName(outer).groupBy("cell", "part").applyInArrow(_compared, "node long, n long, root long")
    return out.unionByName(clique).unionByName(compared)


def _audited(classes: DataFrame, found: DataFrame) -> float:
    """The share of all links of ``AUDIT`` classes, by brute force over all classes, that ``found`` (node, n) has."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(11))).limit(AUDIT).select("node", "cell", "v").collect()
    where = {}
    for k, r in enumerate(sample):
        where.setdefault(r["cell"], []).append(k)
    groups = {c: (np.array(ks), _units(np.array([sample[k]["v"] for k in ks], np.float64)), np.array([sample[k]["node"] for k in ks])) for c, ks in where.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sample), np.int64)
        for batch in batches:
            cells = np.array(batch.column(1).to_pylist(), object)
            for c in set(cells) & set(groups):
                at = np.flatnonzero(cells == c)
                ks, units, nodes = groups[c]
                part = batch.take(pa.array(at))
                fit = units @ _units(_matrix(pa.chunked_array([part.column(3)]))).T >= LEAST
                fit &= nodes[:, None] != part.column(0).to_numpy()[None]
                total[ks] += fit @ part.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([r["node"] for r in sample]), pa.array(total)], names=["node", "n"])

    true = classes.select("node", "cell", "copies", "v").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("want"))
    got = found.join(F.broadcast(true), "node").agg(F.sum("want").alias("want"), F.sum("n").alias("n")).first()
    return got["n"] / got["want"] if got["want"] else 1.0


def embedding_near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (as audited) for every row of ``vectors`` (vec_id, embedding, label).

    Rows whose label or vector is null, zero, empty, or holds null or non-finite components link with
    nothing, and so do vectors of different lengths. Rows that repeat a vec_id are vectors of their own. A row with a null vec_id links with
    nothing: its component_id is null and it is kept. Empty tables give no rows; other columns are ignored.
    """
    ship_by_value()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("v"), "label")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", number) & F.exists("v", lambda x: x != 0)
    group = F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string"))
    key = F.concat(F.hex(F.xxhash64(F.lit(1), group, "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(2), group, "v")))
    keyed = rows.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), key).alias("key"), group.alias("cell"), "v")
    named = keyed.where(F.col("key").isNotNull())
    classes = named.groupBy("key", "cell").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    start = classes.select("node", "cell", F.lit(OPEN).alias("role"), "copies", "v")
    for margin in MARGINS:
        links = staged(_found(_cells(start, margin)), "vector-links")
        counts = staged(links.groupBy("node").agg(F.sum("n").alias("n")), "vector-counts")
        recall = _audited(classes, counts)
        if recall >= RECALL:
            break
    of = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.select("key", "node", "least", "copies").join(counts, "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    # Every class has a row for its component; hot components are the key of many classes, but of one row in ``least``.
    known = staged(joined.join(least, "component").select("key", "copies", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-components")
    out = _joined(named.select("vec_id", "key"), known, "key", "copies", classes.agg(F.sum("copies")).first()[0] or 0).select("vec_id", "n_links", "component_id")
    alone = keyed.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = out.unionByName(alone)
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(float(recall)).alias("recall"))
