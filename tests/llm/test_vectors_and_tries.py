"""Edge cases and brute force for near-duplicate vectors and the trie of conversations."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from support import DATA

from trialweave.llm import convtrie, embdedup


def brute_vectors(rows):
    """n_links and component_id by row, for rows (vec_id, embedding, label)."""

    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    groups, links = collections.defaultdict(list), np.zeros(len(rows), int)
    for i, r in enumerate(rows):
        if usable(r):
            groups[r[2], len(r[1])].append(i)
    for at in groups.values():
        v = np.array([rows[i][1] for i in at], np.float32).astype(np.float64)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        for x, y in zip(*np.nonzero(np.triu(v @ v.T >= 0.93, 1)), strict=True):
            i, j = at[x], at[y]
            links[[i, j]] += 1
            a, b = top(i), top(j)
            root[a] = b
    least = {}
    for i, r in enumerate(rows):
        if usable(r):
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(str((r[0], int(n), least.get(top(i), r[0]), r[0] is None or least.get(top(i), r[0]) == r[0])) for i, (r, n) in enumerate(zip(rows, links, strict=True)))


def found_vectors(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "vec_id long, embedding array<float>, label int, node int, cell string, recall boolean")
    found = embdedup.embedding_near_duplicates(df.repartition(3)).collect()
    assert all(r["recall"] == 1.0 for r in found)
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in found)


def noisy(rng, at, n, noise):
    return (at / np.linalg.norm(at) + rng.normal(size=(n, len(at))) * noise / np.sqrt(len(at))).astype(np.float32).tolist()


def test_vectors_odd_rows(spark):
    one, huge = [1.0, 0.0, 0.5, 0.25], [3e38, 0.0, 1.5e38, 0.75e38]
    rows = [
        (1, one, 1), (2, one, 1), (2, one, 1), (3, [2.0, 0.0, 1.0, 0.5], 1), (4, huge, 1), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1), (9, [1.0, None, 0.5, 0.25], 1),
        (10, [1.0, float("nan"), 0.5, 0.25], 1), (11, [1.0, float("inf"), 0.5, 0.25], 1), (None, one, 1), (None, None, None), (12, one, 2), (-3, [1.0, 0.0, 0.5, 0.2], 1), (13, one[:3], 1), (2, [-1.0, 0.0, 0.0, 0.0], 1),
    ]
    assert found_vectors(spark, rows) == brute_vectors(rows)


def test_vectors_empty(spark):
    assert embdedup.embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("sizes", [{"SHARD": 60, "PART": 50, "SAMPLE": 150, "CHILDREN": 3, "LEVELS": 3}, {"SHARD": 150, "PART": 40, "SAMPLE": 200, "LEVELS": 2}])
def test_vectors_in_many_cells_and_balls(spark, monkeypatch, sizes):
    """A tight group and a wide one of a third of all rows each, pairs, copies and others, in cells so small that every branch is taken."""
    for name, value in sizes.items():
        monkeypatch.setattr(embdedup, name, value)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 24)).astype(np.float32).tolist()
    vectors += noisy(rng, rng.normal(size=24), 260, 0.1) + noisy(rng, rng.normal(size=24), 260, 0.27)
    vectors += [x for v in rng.normal(size=(40, 24)) for x in noisy(rng, v, 2, 0.2)] + vectors[:1] * 30
    rows = [(int(i), v, int(i) % 7 // 6) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    assert found_vectors(spark, rows) == brute_vectors(rows)


def test_vectors_search_finds_what_is_in_range_without_a_scan():
    rng = np.random.default_rng(5)
    units = embdedup._units(np.concatenate([rng.normal(size=(1500, 32)), *(np.array(noisy(rng, v, 3, 0.2)) for v in rng.normal(size=(300, 32)))])).astype(np.float32)
    near = embdedup._lists(units, *embdedup.pruned(units), embdedup.DEGREE)
    medoids = np.unique((embdedup.centroids(units.astype(np.float64), embdedup.MEDOIDS, 3).astype(np.float32) @ units.T).argmax(axis=1))
    total = found = own = 0
    for a in range(0, len(units), 256):
        queries = np.arange(a, min(len(units), a + 256))
        who, to, ended = embdedup.search(units, near, medoids, queries)
        got, want = set(zip(queries[who], to, strict=True)), set(zip(*((x + [[a], [0]][k]).tolist() for k, x in enumerate(np.nonzero(units[queries] @ units.T >= 0.93))), strict=True))
        total, found, own = total + len(want), found + len(got & want), own + int(ended.sum())
    assert found >= 0.9 * total
    assert own >= 0.9 * len(units)


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    members, children, leaves, saved = collections.defaultdict(list), collections.defaultdict(list), {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c, ends in members[p] if ends)).encode()).hexdigest()
    return sorted(str((min(members[p])[0], len(p), min(members[p[:-1]])[0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], digest(p))) for p in members)


def found_trie(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sizes", [{}, {"CELLS": 40, "TASK": 60, "LEAST_ROWS": 3}])
def test_trie_odd_rows(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(convtrie, name, value)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {c % 3 if t > 1 else ''} 🙂") for c in range(330) for t in range(c % 5 + 1)]
    rows += [(c, t, "system", "the same") for c in range(1000, 1200) for t in range(7)]  # a third of all rows
    rows += [(1300 + c, None if t == 2 else t, None if c % 2 else "user", None if t % 3 == 0 else "x" * t) for c in range(9) for t in range(4)]
    rows += [(1400, 0, "user", "long " * 40000)] + [(1401, t, "user", f"{t}") for t in range(500)] + [(1402, 1, "user", "twice"), (1402, 1, "user", "twice"), (None, 0, "user", "no id"), (2105, 0, "", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", size int, key string").repartition(5)
    assert found_trie(convtrie.prefix_trie(df)) == brute_trie(rows)


def test_trie_over_several_levels(spark, monkeypatch):
    for name, value in {"CELLS": 300, "TASK": 400, "LEAST_ROWS": 4}.items():
        monkeypatch.setattr(convtrie, name, value)
    df = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    assert found_trie(convtrie.prefix_trie(df)) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_empty(spark):
    assert convtrie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert convtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)).collect() == []
