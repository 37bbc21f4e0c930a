"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are words; a text ends with one end token. Every context is a restaurant. The context of a
token is the two words before it: the restaurant of the pair has the restaurant
of its last word as parent. Restaurants of words share one root over all words, in which a
text's first token sits too; below the root is the uniform distribution over the V known words
and one unknown one. The restaurant of a word with more than ``SPLIT`` tokens is
divided by a digest of the word before, so that no restaurant grows with the corpus without bound.

The state of the Chinese-restaurant seating is the number of tables that serve each word in each
restaurant. Given a word's c customers its tables t have probability proportional to
S(c, t) * [theta + d, d]_(T) * P(w)^t, with generalised Stirling numbers S, the tables T of the whole restaurant
and the parent's predictive P(w). A gamma variable for each restaurant, drawn from Gamma(theta / d + T), makes its
words independent of each other: t has weight S(c, t) * x^t with x = d * gamma * P(w), so all of them are drawn at once.
A restaurant's predictive probabilities come from the seats and totals of one and the
same state, so they sum to 1 in every context; they are averaged over the last sweeps.

How the work is dealt:

1. Tasks turn documents into chunks of about ``CHUNK`` tokens, as numbers of the chunk's
   own words. Words go to owners by hash, which count them over the corpus and give them
   numbers, small ones to frequent words.
2. Chunks send their (pair or word, word) types to buckets by context, with training counts and
   the documents that have them. A restaurant, and the pairs below it, are whole in a bucket.
3. Buckets start with one table a type and send their tables by word to the words' owners,
   which seat the root and answer. Each burn-in round then sweeps over all restaurants, whose
   tables are kept from round to round. Only sums over all words reach the driver.
4. At last buckets average over sweeps, add up log probabilities by document, and send these sums.

A row for an owner or a bucket is made only where there is something to send, so there are
never more rows than types. Words are told apart by 64-bit hashes. Counts, vocabulary and
seats cover all training documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import discard, release, ship_by_value, staged

#: Tokens in a chunk, and of the corpus in a bucket.
CHUNK, BUCKET = 1_000_000, 1_000_000
#: Restaurants of words with more than so many tokens are divided.
SPLIT = 1_000_000
#: More than the most parts of a restaurant.
PARTS = 1 << 20
#: Strength of all restaurants, burn-in rounds and sweeps in each, averaged sweeps, and the seed.
THETA, BURN_IN, SWEEPS, AVERAGED, SEED = 1.0, 1, 4, 4, 29
#: Tables of up to so many customers are drawn from their weights, others by so many steps of a sampler for the same weights.
TABULATED, STEPS = 64, 12
#: Weights of tables that are worked out at a time, few enough for a core's cache.
LOT = 50_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, whole ones no wider than need be; equal bytes of the numbers lie together, which compresses best."""
    parts = []
    for a in map(np.ascontiguousarray, arrays):
        a = a.astype(np.min_scalar_type(a.max())) if a.dtype.kind in "iu" and len(a) and a.min() >= 0 else a
        octets, planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize), np.empty((a.dtype.itemsize, len(a)), np.uint8)
        for k in range(len(planes)):  # far faster than one transposed copy
            planes[k] = octets[:, k]
        parts += [f"{a.dtype.str}:{len(a)}\n".encode(), planes.data.cast("B") if len(a) else b""]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        head = raw.index(b"\n", at)
        kind, n = raw[at:head].decode().split(":")
        dtype, n = np.dtype(kind), int(n)
        at = head + 1 + n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, head + 1).reshape(dtype.itemsize, n)
        octets = np.empty((n, dtype.itemsize), np.uint8)
        for k in range(len(planes)):
            octets[:, k] = planes[k]
        found = octets.view(dtype).reshape(n)
        out.append(found.astype(np.int64) if dtype.kind in "iu" and dtype != np.uint64 else found)
    return out


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, the end among them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at the six ASCII blanks
    return np.append(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64), _END)


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them; by hashing, as values repeat."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return found[order], rank[codes]


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of ``values``, the values in it, and which of these are the first of their kind.

    Whole numbers that leave room for their place in the low bits are sorted together with it, which takes a fraction of an indirect sort.
    """
    bits = len(values).bit_length()
    if len(values) and values.min() >= 0 and int(values.max()) >> (63 - bits) == 0:
        both = np.sort(values << bits | np.arange(len(values)))
        order, values = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(values, kind="stable")
        values = values[order]
    return order, values, np.append(True, values[1:] != values[:-1])[: len(values)]


def _placed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_ranked`` for values that hardly repeat."""
    order, values, new = _sorted(values)
    rank = np.empty_like(order)
    rank[order] = np.cumsum(new) - 1
    return values[new], rank


def _ranked_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_ranked`` for values of which equal ones mostly stand together: only the first of each run is sorted."""
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    found, rank = _placed(values[new])
    return found, rank[np.cumsum(new) - 1]


def _spread(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each number; ``buckets`` is a power of two."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(65 - buckets.bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(x), np.int64)


def _cuts(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for each run of ``owner``, which is sorted."""
    at = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
    yield from ((int(owner[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)) if len(owner) else ()


def _chunks(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shift = np.uint64(65 - buckets.bit_length())

    def chunk(rows: list[tuple], number: int) -> pa.RecordBatch:
        """One row (bucket -1) with the documents and their tokens, and one for each owner of the chunk's words."""
        ids, held, found = zip(*rows, strict=True)
        sizes, null = np.array([len(h) for h in found], np.int64), np.array([i is None for i in ids])
        words, token = _ranked(np.concatenate(found))
        learnt = np.repeat(~np.array(held), sizes)
        trained = np.bincount(token[learnt], minlength=len(words))
        data = [_packed(np.where(null, 0, np.array([i or 0 for i in ids], np.int64)), null, np.array(held), sizes, token)]
        owner, to = (words >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(words), np.int64), [-1]
        for bucket, a, b in _cuts(owner):
            to.append(bucket)
            data.append(_packed(_deltas(words[a:b]), trained[a:b]))
        n = [int(learnt.sum()), *[0] * (len(to) - 1)]
        return pa.RecordBatch.from_arrays([pa.array([number] * len(to)), pa.array(to, pa.int32()), pa.array(n), pa.array(data, pa.binary())], names=["chunk", "bucket", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, text, held in zip(*batch.columns, strict=True):
                rows.append((doc_id.as_py(), held.as_py(), tokens(text.as_py())))
                size += len(rows[-1][2])
                if size >= CHUNK:
                    yield chunk(rows, number)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield chunk(rows, number)

    return run


def _numbered(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def assign(key: tuple, table: pa.Table) -> pa.Table:
        """For each chunk, the numbers and training counts of its words with one owner; and for all of them, how many words are known."""
        parts = [_unpacked(x.as_py()) for x in table.column("data")]
        asked = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * buckets + key[0].as_py()
        at = np.split(place, np.cumsum([len(x) for x in asked])[:-1])
        known = np.zeros(len(parts), np.int64)
        known[0] = (counts > 0).sum()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": pa.array(known), "data": pa.array([_packed(number[x], counts[x]) for x in at], pa.binary())})

    return assign


def _nested(context: np.ndarray, before: np.ndarray, word: np.ndarray, c: np.ndarray) -> bytes:
    """Types in order of context, word before and word, packed: each context once, then its words before, then theirs, as differences."""
    new = np.append(True, np.diff(context) != 0)[: len(context)]
    contexts, pairs = np.flatnonzero(new), np.flatnonzero(new | np.append(True, np.diff(before) != 0)[: len(context)])

    def inner(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = _deltas(values)
        out[starts] = values[starts]
        return out

    owned = np.searchsorted(pairs, contexts)
    return _packed(_deltas(context[contexts]), np.diff(owned, append=len(pairs)), inner(before[pairs], owned), np.diff(pairs, append=len(context)), inner(word, pairs), c)


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of which ``values`` are the differences, begun anew after each of ``sizes``."""
    sums = np.cumsum(values)
    starts = np.cumsum(sizes) - sizes
    return sums - np.repeat(np.append(0, sums)[starts], sizes)


def _types(data: bytes) -> list[np.ndarray]:
    """(word of the context, part, word before, word, count) of what ``_nested`` has packed."""
    contexts, owned, before, sizes, word, c = (x.astype(np.int64, copy=False) for x in _unpacked(data))  # contexts far apart come as uint64
    context, before = np.repeat(np.cumsum(contexts), owned), _summed(before, owned)
    context, before = np.repeat(context, sizes), np.repeat(before, sizes)
    return [context // PARTS, context % PARTS, before, _summed(word, sizes), c]


def _routes(buckets: int, trained: int, vocabulary: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def route(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        """A chunk's types for each bucket with the documents that have them; and (bucket -1) its documents with their unigram scores."""
        ids, null, held, sizes, token = _unpacked(texts.column("data")[0].as_py())
        pieces = [_unpacked(data) for _, data in sorted(zip(found.column("bucket").to_pylist(), found.column("data").to_pylist(), strict=True))]
        number, count = (np.concatenate([p[k] for p in pieces]) for k in range(2))
        starts, held = np.cumsum(sizes) - sizes, held.astype(bool)
        base = np.log10((count + 0.5) / (trained + 0.5 * (vocabulary + 1)))
        to, data, docs = [-1], [_packed(ids, null, held, sizes, np.add.reduceat((count > 0).astype(np.int64)[token], starts), np.add.reduceat(base[token], starts))], [b""]

        # Codes of the word before (0: none), and of the word before that (0: no pair, as there is none or the last word isn't known).
        word, n = number[token], np.append(0, count[token[:-1]])
        last = np.append(0, word[:-1] + 1)
        last[starts] = n[starts] = 0
        pair = np.where(n > 0, 1 + np.append(0, last[:-1]), 0)
        context = last * PARTS + pair % (n // SPLIT + 1)
        first = _spread(word[starts], buckets)
        context[starts] = -1 - first  # a first token has no restaurant but the root, and goes where its word belongs
        contexts, own = _ranked(context)
        bucket = np.where(contexts < 0, -1 - contexts, _spread(contexts, buckets))
        by_bucket = np.argsort(bucket, kind="stable")
        place = np.empty_like(by_bucket)
        place[by_bucket] = np.arange(len(by_bucket))
        pairs, pair = _ranked(pair)
        by_number = np.argsort(number)  # of the chunk's distinct words, all of which are among its tokens
        words, rank = number[by_number], np.empty_like(by_number)
        rank[by_number] = np.arange(len(rank))
        word = rank[token]
        both, kind = _placed(place[own] * len(pairs) + pair)
        by_kind, kinds, new = _sorted(kind * len(words) + word)
        kinds, kind[by_kind] = kinds[new], np.cumsum(new) - 1
        both, of_word = both[kinds // len(words)], kinds % len(words)
        owner = by_bucket[both // len(pairs)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        learnt = np.bincount(kind[~held[doc]], minlength=len(kinds))
        each = np.bincount(kind, minlength=len(kinds))
        doc = doc[by_kind]
        ends = np.append(0, np.cumsum(each))
        before, word, context = pairs[both % len(pairs)], words[of_word], np.maximum(contexts[owner], 0)
        for to_bucket, a, b in _cuts(bucket[owner]):
            to.append(to_bucket)
            data.append(_nested(context[a:b], before[a:b], word[a:b], learnt[a:b]))
            docs.append(_packed(each[a:b], doc[ends[a] : ends[b]]))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(to)), "bucket": pa.array(to, pa.int32()), "types": pa.array(data, pa.binary()), "docs": pa.array(docs, pa.binary())})

    return route


def log_stirling(d: float, most: int = TABULATED) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers for discount ``d``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.log(np.maximum(c - d * t, 0)) + out[c, 1 : c + 2])
    return out


def _log_ratio(d: float) -> Callable[[np.ndarray], np.ndarray]:
    """log of Gamma(m - d) / Gamma(m), up to a constant, as a function of whole m from 1 up."""
    known = np.append(0.0, np.cumsum(np.log1p(-d / np.arange(1, 512))))
    smooth = lambda x: -d * np.log(x) + d * (d + 1) / (2 * x)
    return lambda m: np.where(m <= 512, known[np.minimum(m, 512) - 1], known[-1] + smooth(np.maximum(m, 512.0)) - smooth(512.0))


def _tables_of_many(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables with weights S(c, t) * x^t, for c of any size.

    With these weights, tables are a Poisson number (of mean x / d) of independent sizes k with
    probability d * Gamma(k - d) / (Gamma(1 - d) * k!), given that sizes add up to c. One
    table, chosen by its size, takes what the others leave. A step draws all the others anew,
    sizes damped by z^k so that they add up to about c, and is accepted by the ratio of
    m^(1) * p(m) * z^m of the chosen table's size m; the exact distribution is stationary.
    """
    rate = x / d
    low, high = np.full(len(c), -45.0), np.full(len(c), -1e-12)  # of log(1 - z): d * rate * z * (1 - z)^(d - 1) = c
    log_rate, log_c, log_ratio = np.log(d * rate), np.log(c), _log_ratio(d)
    for _ in range(50):
        middle = (low + high) / 2
        more = log_rate + np.log(-np.expm1(middle)) + (d - 1) * middle > log_c
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    log_z = np.log1p(-np.exp(low))
    t, m = np.ones(len(c), np.int64), c.astype(np.int64)
    weigh = lambda m: log_ratio(m) + m * log_z
    for _ in range(STEPS):
        n = rng.poisson(rate)
        owner = np.repeat(np.arange(len(c)), n)
        k = rng.geometric(np.maximum(rng.beta(d, 1 - d, len(owner)), 1e-12)).astype(np.float64)
        stays = rng.random(len(owner)) < np.exp(np.maximum(k * log_z[owner], -700.0))
        own = c - np.bincount(owner[stays], k[stays], len(c))
        fits = own >= 1
        new = np.where(fits, own, 1).astype(np.int64)
        taken = fits & (np.log(rng.random(len(c))) < weigh(new) - weigh(m))
        t, m = np.where(taken, 1 + np.bincount(owner[stays], minlength=len(c)), t), np.where(taken, new, m)
    return t


def draw_tables(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator, stirling: np.ndarray | None = None) -> np.ndarray:
    """Numbers of tables with weights S(c, t) * x^t for dishes with c customers; ``stirling`` is ``log_stirling(d)``, if it is at hand."""
    t = np.minimum(c, 1)
    small = np.flatnonzero((c > 1) & (c <= TABULATED))
    small = small[np.argsort(c[small].astype(np.uint8), kind="stable")]  # of bytes: a radix sort
    stirling = log_stirling(d) if stirling is None else stirling
    for n, a, b in _cuts(c[small]):
        for at in range(a, b, LOT // n):
            lot = small[at : min(at + LOT // n, b)]
            log_x = np.log(x[lot])
            share = stirling[n, 1 : n + 1, None] + np.arange(1, n + 1)[:, None] * log_x  # a row for each t, as loops over long rows are fast
            share -= share.max(axis=0)
            np.cumsum(np.exp(share, out=share), axis=0, out=share)
            t[lot] = 1 + (share < rng.random(len(lot)) * share[-1]).sum(axis=0)
    for lot in np.array_split(many := np.flatnonzero(c > TABULATED), len(many) // 20_000 + 1):
        if len(lot):
            t[lot] = _tables_of_many(c[lot], x[lot], d, rng)
    return t


class Level:
    """Restaurants of one kind: for each type (dish in a restaurant) its restaurant, and the seats."""

    def __init__(self, restaurant: np.ndarray, n: int, d: float) -> None:
        self.restaurant, self.n, self.d, self.stirling = restaurant, n, d, log_stirling(d)
        self.tables = np.zeros(len(restaurant), np.int64)

    def totals(self, numbers: np.ndarray) -> np.ndarray:
        return np.bincount(self.restaurant, numbers, self.n)

    def predictive(self, c: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """P(dish | restaurant) given customers, the parent's P(dish) and the present seats."""
        mass, customers = THETA + self.d * self.totals(self.tables), THETA + self.totals(c)
        return (np.maximum(c - self.d * self.tables, 0) + mass[self.restaurant] * parent) / customers[self.restaurant]

    def sweep(self, c: np.ndarray, parent: np.ndarray, rng: np.random.Generator, open_: np.ndarray | None = None) -> None:
        """Draws all tables anew. ``open_`` are the dishes with two customers or more, whose ``parent`` then suffices: others have as many tables as customers."""
        if open_ is None:
            open_ = np.flatnonzero(c > 1)
            parent = parent[open_]
        gamma, busy = THETA / self.d + self.totals(self.tables), np.zeros(self.n, bool)
        busy[self.restaurant[open_]] = True
        gamma[busy] = rng.standard_gamma(gamma[busy])
        self.tables = np.minimum(c, 1)
        self.tables[open_] = draw_tables(c[open_], self.d * gamma[self.restaurant[open_]] * parent, self.d, rng, self.stirling)


class Bucket:
    """The types of one bucket, those that only held-out texts have among them.

    ``kinds`` are its distinct (restaurant of a word, word before that, word); each is direct (a first token, in the root),
    of a pair, or of a word. ``inverse`` tells where the types of which it was made stand.
    """

    def __init__(self, parts: list[list[np.ndarray]], d: tuple[float, float] = (0.5, 0.5)) -> None:
        v, part, before, word, c = (np.concatenate([p[k] for p in parts]) for k in range(5))
        owners, own = _ranked_runs(v * PARTS + part)
        befores, before = _ranked_runs(before)
        self.words, word = _ranked(word)
        nb, nw = len(befores), len(self.words)
        pairs, own = _placed(own * nb + before)
        kinds, self.inverse = _placed(own * nw + word)
        self.c = np.bincount(self.inverse, c, len(kinds)).astype(np.int64)
        del v, part, before, word, c, own
        self.word, pair = kinds % nw, pairs[kinds // nw]
        direct = owners[pair // nb] < PARTS
        paired = ~direct & (befores[pair % nb] > 0)
        self.direct, self.pair, self.single = np.flatnonzero(direct), np.flatnonzero(paired), np.flatnonzero(~direct & ~paired)
        # Dishes of words' restaurants, for kinds that aren't direct; pairs are customers there by their tables.
        rest = np.flatnonzero(~direct)
        dishes, dish = _placed(pair[rest] // nb * nw + self.word[rest])
        self.dish_of = np.zeros(len(kinds), np.int64)
        self.dish_of[rest] = dish
        self.dish_word = dishes % nw if nw else dishes
        first = np.append(True, np.diff(pair[self.pair]) != 0)[: len(self.pair)]
        self.pairs = Level(np.cumsum(first) - 1, int(first.sum()), d[0])
        self.singles = Level(dishes // nw if nw else dishes, len(owners), d[1])
        # What no sweep changes: pairs' dishes, customers and open dishes, and the customers that words' dishes have besides pairs' tables.
        self.pair_dish, self.pair_c = self.dish_of[self.pair], self.c[self.pair]
        self.open = np.flatnonzero(self.pair_c > 1)
        self.open_dish = self.pair_dish[self.open]
        self.pairs.tables = np.minimum(self.pair_c, 1)
        closed = self.pairs.tables.copy()
        closed[self.open] = 0
        n = len(self.dish_word)
        self.settled = (np.bincount(self.dish_of[self.single], self.c[self.single], n) + np.bincount(self.pair_dish, closed, n)).astype(np.int64)
        self.singles.tables = np.minimum(self.customers(), 1)

    def customers(self) -> np.ndarray:
        """Of each dish in a word's restaurant."""
        return self.settled + np.bincount(self.open_dish, self.pairs.tables[self.open], len(self.dish_word)).astype(np.int64)

    def sweep(self, p: np.ndarray, rng: np.random.Generator) -> None:
        """One Gibbs sweep over all restaurants, given the root's P(w)."""
        p = p[self.dish_word]
        self.pairs.sweep(self.pair_c, self.singles.predictive(self.customers(), p)[self.open_dish], rng, self.open)
        self.singles.sweep(self.customers(), p, rng)

    def predictive(self, p: np.ndarray) -> np.ndarray:
        """P(word | context) of each kind by the present seats."""
        of_words, out = self.singles.predictive(self.customers(), p[self.dish_word]), p[self.word].copy()
        out[self.single] = of_words[self.dish_of[self.single]]
        out[self.pair] = self.pairs.predictive(self.pair_c, of_words[self.pair_dish])
        return out

    def for_root(self) -> np.ndarray:
        """The root's customers by word."""
        return (np.bincount(self.dish_word, self.singles.tables, len(self.words)) + np.bincount(self.word[self.direct], self.c[self.direct], len(self.words))).astype(np.int64)

    def told(self, number: int, buckets: int) -> pa.Table:
        """The seats, for this bucket itself, and the root's customers by word for the words' owners."""
        customers, owner = self.for_root(), self.words % buckets
        order = np.argsort(owner, kind="stable")
        to, data = [-1], [_packed(self.pairs.tables, self.singles.tables)]
        for bucket, a, b in _cuts(owner[order]):
            at = order[a:b]
            to.append(bucket)
            data.append(_packed(_deltas(self.words[at] // buckets), customers[at]))
        c, dishes = self.pair_c, self.customers()
        return _rows(to, number, data, [int(x) for x in ((c == 1).sum(), (c == 2).sum(), (dishes == 1).sum(), (dishes == 2).sum(), customers.sum())])


def root_p(customers: np.ndarray, tables: np.ndarray, model: dict) -> np.ndarray:
    """The root's P(w) of words with so many customers and tables; 0 and 0 for an unknown word."""
    mass = THETA + model["root_d"] * model["root_tables"]
    return (np.maximum(customers - model["root_d"] * tables, 0) + mass * model["uniform"]) / (THETA + model["root_customers"])


_MESSAGE = "bucket int, sender int, data binary, s0 long, s1 long, s2 long, s3 long, s4 long"


def _rows(to: list[int], sender: int, data: list[bytes], sums: list[int]) -> pa.Table:
    """Messages; the first of them has sums for the driver."""
    first = np.zeros((len(to), 5), np.int64)
    first[0, : len(sums)] = sums
    return pa.table({"bucket": pa.array(to, pa.int32()), "sender": pa.array([sender] * len(to), pa.int32()), "data": pa.array(data, pa.binary()), **{f"s{k}": pa.array(first[:, k]) for k in range(5)}})


def _seating(model: dict | None, seed: list[int]) -> Callable[[tuple, pa.Table], pa.Table]:
    def seat(key: tuple, table: pa.Table) -> pa.Table:
        """The root's customers and tables of the words of one owner, for each bucket that has such words."""
        number, senders = key[0].as_py(), table.column("sender").to_pylist()
        parts = [_unpacked(x.as_py()) for x in table.column("data")]
        asked = [np.cumsum(p[0]) for p in parts]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        customers = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        tables = np.minimum(customers, 1)
        if model:
            rng = np.random.default_rng([*seed, number])
            gamma = np.random.default_rng(seed).standard_gamma(THETA / model["root_d"] + model["root_tables"])  # the same for all owners
            tables = draw_tables(customers, np.full(len(words), model["root_d"] * gamma * model["uniform"]), model["root_d"], rng)
        at = [np.searchsorted(words, x) for x in asked]
        return _rows(senders, number, [_packed(customers[k], tables[k]) for k in at], [int(x) for x in ((customers == 1).sum(), (customers == 2).sum(), tables.sum())])

    return seat


def _got(table: pa.Table, bucket: Bucket, model: dict, buckets: int) -> np.ndarray:
    """Sets a bucket's seats from its own message and returns the root's P(w) of its words from those of their owners."""
    found = dict(zip(table.column("sender").to_pylist(), table.column("data").to_pylist(), strict=True))
    bucket.pairs.tables, bucket.singles.tables = _unpacked(found.pop(-1))
    p, owner = np.empty(len(bucket.words)), bucket.words % buckets
    order = np.argsort(owner, kind="stable")
    p[order] = root_p(*(np.concatenate(x) for x in zip(*(_unpacked(found[k]) for k in sorted(found)), strict=True)), model)
    return p


def _held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 5; a null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def lm_scores(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (a smoothed unigram
    model's log10 probability), score (this model's) and perplexity (by this model). Null and empty texts
    are one end token. Null ids are trained on; rows that repeat a doc_id
    are documents of their own; an empty table gives no rows. Without any training
    document every token is unknown and has probability 1. Other columns are ignored.
    """
    ship_by_value()
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", _held_out(F.col("doc_id")).alias("held"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 << max(4, int(size / 6 // BUCKET).bit_length())

    chunks = staged(rows.mapInArrow(_chunks(buckets), "chunk long, bucket int, n long, data binary"), "lm-chunks")
    trained = chunks.agg(F.sum("n")).first()[0] or 0
    numbers = staged(chunks.where("bucket >= 0").groupBy("bucket").applyInArrow(_numbered(buckets), "chunk long, bucket int, n long, data binary"), "lm-words")
    vocabulary = numbers.agg(F.sum("n")).first()[0] or 0
    routed = chunks.where("bucket < 0").groupBy("chunk").cogroup(numbers.groupBy("chunk"))
    types = staged(routed.applyInArrow(_routes(buckets, trained, vocabulary), "chunk long, bucket int, types binary, docs binary"), "lm-types")
    for table in (chunks, numbers):
        discard(table)
    release(spark)

    def begin(key: tuple, table: pa.Table) -> pa.Table:
        return Bucket([_types(x.as_py()) for x in table.column("types")]).told(key[0].as_py(), buckets)

    def summed(sent: DataFrame) -> list[int]:
        return [x or 0 for x in sent.agg(*(F.sum(f"s{k}") for k in range(5))).first()]

    own = types.where("bucket >= 0").select("bucket", "chunk", "types")
    sent = staged(own.groupBy("bucket").applyInArrow(begin, _MESSAGE), "lm-tables")
    discount = lambda a, b: min(max(a / (a + 2 * b), 0.1), 0.95) if a else 0.5
    ones, twos, dish_ones, dish_twos, _ = summed(sent)
    model: dict = {"d": (discount(ones, twos), discount(dish_ones, dish_twos)), "uniform": 1 / (vocabulary + 1)}

    def root(sent: DataFrame, round_: int) -> DataFrame:
        """Seats the root for the customers that ``sent`` has, completes ``model``, and returns what each bucket gets."""
        first = "root_d" not in model
        replies = staged(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_seating(None if first else dict(model), [seed, round_]), _MESSAGE), "lm-root")
        ones, twos, tables, *_ = summed(replies)
        model.update(root_customers=summed(sent)[4], root_tables=tables, root_d=discount(ones, twos) if first else model["root_d"])
        kept = sent.where("bucket < 0").select(F.col("sender").alias("bucket"), F.col("bucket").alias("sender"), "data")
        return kept.unionByName(replies.select("bucket", "sender", "data"))

    def sweeping(model: dict, round_: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
        def sit(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
            bucket, number = Bucket([_types(x.as_py()) for x in table.column("types")], model["d"]), key[0].as_py()
            p, rng = _got(found, bucket, model, buckets), np.random.default_rng([seed, number, round_])
            for _ in range(SWEEPS):
                bucket.sweep(p, rng)
            return bucket.told(number, buckets)

        return sit

    def answering(model: dict) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
        def answer(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
            """For each chunk, sums of log probabilities by document."""
            parts = [_types(x.as_py()) for x in table.column("types")]
            bucket = Bucket(parts, model["d"])
            p, rng, mean = _got(found, bucket, model, buckets), np.random.default_rng([seed, key[0].as_py(), BURN_IN]), np.zeros(len(bucket.c))
            for _ in range(AVERAGED):
                bucket.sweep(p, rng)
                mean += bucket.predictive(p) / AVERAGED
            logs, data = np.log10(mean), []
            for at, x in zip(np.split(bucket.inverse, np.cumsum([len(p[0]) for p in parts])[:-1]), table.column("docs"), strict=True):
                each, doc = _unpacked(x.as_py())
                sums = np.bincount(doc, np.repeat(logs[at], each))
                have = np.flatnonzero(sums)
                data.append(_packed(_deltas(have), sums[have]))
            return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})

        return answer

    held = root(sent, 0)
    for round_ in range(BURN_IN):
        sent = staged(own.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(sweeping(dict(model), round_), _MESSAGE), "lm-tables")
        held = root(sent, round_ + 1)
        release(spark)
    full = types.where("bucket >= 0").groupBy("bucket").cogroup(held.groupBy("bucket"))
    sums = staged(full.applyInArrow(answering(dict(model)), "chunk long, bucket int, data binary"), "lm-sums")
    texts = staged(types.where("bucket < 0").select("chunk", F.col("types").alias("data")), "lm-texts")
    discard(types)
    release(spark)

    def score(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, null, held, sizes, known, base = _unpacked(texts.column("data")[0].as_py())
        total = np.zeros(len(ids))
        for _, data in sorted(zip(found.column("bucket").to_pylist(), found.column("data").to_pylist(), strict=True)):
            doc, logs = _unpacked(data)
            total[np.cumsum(doc)] += logs
        total = total if trained else np.zeros(len(ids))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), trained, np.int64)), "base_score": pa.array(base), "score": pa.array(total), "perplexity": pa.array(10 ** (-total / sizes))})

    return texts.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(score, _SCORES)
