"""Edge cases and brute force for the ranked search."""

import collections
import math
import re

import numpy as np
import pytest
from support import DATA

from trialweave.llm import lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    counts = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    documents, total = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), held, n in zip(docs, counts, sizes, strict=True):
            score = 0
            for t, times in collections.Counter(terms(text)).items():
                if held[t]:
                    score += times * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * held[t] // (1000 * held[t] + 12 * (75 + 25 * n * documents // total)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scored)[:20], 1)]
    return sorted(map(str, out))


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, k int, item_id string").repartition(3)
    i = spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, score double")
    return sorted(str(tuple(r)) for r in lexsearch.ranked_search(d, i).select("item_id", "rank", "doc_id", "score").collect())


def test_terms_are_those_of_the_pattern():
    every = "".join(map(chr, [*range(0x250), 0x3000, 0x1F642])) + "MIXED Case\x00words\x7fand ÄÖ"
    assert [t.decode() for t in lexsearch.terms(every.encode())] == terms(every)
    assert lexsearch.terms(None) == lexsearch.terms(b"") == []


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3, "SHARD": 17, "TERMS": 12, "FIRST": 2, "CELLS": 400}])
def test_search_odd_rows(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexsearch, name, value)
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    docs = [(int(k), " ".join(rng.choice(words, int(rng.integers(1, 60)), p=np.arange(60, 0, -1) / 1830))) for k in rng.permutation(150)]
    docs += [(500 + k, "the very same text, w3 w4") for k in range(80)]  # ties
    docs += [(600, None), (601, ""), (602, " .,; "), (None, "w1 w59 rare"), (7, "w1 w2 w59"), (7, "w1 w2 w59"), (603, "W1-É é ÄW3 w1 " * 20000)]
    items = [(0, "w1 w2 w3 w3 w59"), (1, "W4 w3, same TEXT"), (2, None), (3, ""), (4, "nothing that stands anywhere"), (5, "é É äw3 w58"), (6, "rare"), (5, "w7 w8 w9 w10"), (None, "w11 rare rare"), (8, " ".join(f"w{k} x{k}" for k in range(700)))]
    assert found(spark, docs, items) == brute(docs, items)


def test_search_empty(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, "a")], [(1, None)]) == []


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "SHARD", 130)
    docs, items = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet")
    got = sorted(str(tuple(r)) for r in lexsearch.ranked_search(docs, items).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_blocks_are_skipped_by_bounds_only():
    """Far fewer documents are scored than hold a term, and the best are those of scoring all."""
    rng = np.random.default_rng(2)
    matrix = np.where(rng.random((2000, 40)) < np.linspace(0.5, 0.01, 40), rng.integers(1, 900_000, (2000, 40)), 0).astype(np.float32)
    weights = np.sort(rng.integers(1, 9000, 40))[::-1]
    item = np.arange(40)[::-1]
    shard = lexsearch.Shard(list(range(2000)), matrix, [item], lexsearch.places([item]))
    docs, scores = shard.best(item, weights.astype(np.float64), 0)
    every = matrix[:, item].astype(np.float64) @ weights
    assert sorted(scores.tolist()) == sorted(every[every >= np.sort(every)[-lexsearch.TOP]].astype(np.int64).tolist())
    assert len(shard.lists) < 40
