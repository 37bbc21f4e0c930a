"""Best-fit packing of documents into sequences of tokens.

1. Tasks turn each text into token ids and cut only what is longer than a
   sequence into pieces. A row of a piece has its length and checksum, no ids.
2. Best-fit decreasing places pieces by length alone, so all pieces of one length are
   placed together: a plan over the counts of each length, at most ``capacity``
   numbers, says which ranks of a length go where. A segment tree over the
   remaining capacities finds the tightest open sequence in logarithmic time. The plan
   is that of packing all pieces one by one, over the whole corpus, and its
   size depends on the capacity only: each of at most 4 * capacity runs of
   sequences is taken up at most log2(capacity) times, for what remains of it at least halves.
3. Pieces get their rank among those of the same length, by cells of about
   ``CELL`` rows and parts of ``PART`` cells, and look up their place.
"""

from __future__ import annotations

import array
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import ship_by_value, staged

CAPACITY, END, CELL, PART = 1024, 2, 1000, 4096
#: How many words a worker remembers the ids of before it forgets those not met since, and the longest of them.
REMEMBERED, LONGEST = 600_000, 48
#: How byte-level BPE splits a text before it merges; the public pattern of that kind of tokenizer.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Only between blanks that stand alone can a text be cut without changing its ids.
_TOGETHER = re.compile(r"\s\s|[\x1c-\x1f\x85]")


class Words(dict):
    """From words to their ids as little-endian bytes, made when first asked for and remembered.

    Once there are ``REMEMBERED`` of them they become the ``old`` ones, of which only those asked for again stay.
    """

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Ids of texts as little-endian bytes.

    The tokenizer's model merges one word at a time, so a text's ids are those of its
    words in a row. Words repeat, and a look-up is far cheaper than merging.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Texts with one of these have it as one id, and are cut around it.
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.merge, self.split = self.whole.model.tokenize, regex.compile(_SPLIT)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 up
        self.table = dict(zip([*shown, *sorted({*range(256)} - {*shown})], map(chr, [*shown, *range(256, 512)]), strict=False))
        self.marks = {x: self.word(x) for x in ".,"}
        self.line = self.word("\n")
        self.bare, self.spaced = Words(self.pieces), Words(self.after_space)

    def word(self, word: str) -> bytes:
        return array.array("I", [x.id for x in self.merge(word.encode().decode("latin-1").translate(self.table))]).tobytes()

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.word, self.split.findall(text)))

    def after_space(self, word: str) -> bytes:
        """The ids of a space and a word, which may have line ends inside."""
        if word.isalpha():
            return self.word(" " + word)
        if "\n" in word:
            return self.lines(word, self.spaced)
        if word[-1:] in self.marks and word[:-1].isalpha():
            return self.spaced[word[:-1]] + self.marks[word[-1]]
        return self.pieces(" " + word)

    def lines(self, word: str, first: Words) -> bytes:
        head, *rest = word.split("\n")
        return self.line.join([first[head] if head or first is self.spaced else b"", *(self.bare[x] for x in rest)])

    def encode(self, text: str) -> bytes:
        try:
            flat = text.replace("\n", " ")
            # As cheap a test as can be first: blanks that stand alone, spaces and line ends only.
            if (" ".join(flat.split()) != flat and _TOGETHER.search(text)) or any(x in text for x in self.added):
                return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            first, *rest = text.split(" ")
            return self.lines(first, self.bare) + b"".join(map(self.spaced.__getitem__, rest))
        except UnicodeEncodeError:
            return self.encode(text.encode("utf-8", "replace").decode())


def _encoder(path: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    state = sys.modules.setdefault("_packing_state", types.ModuleType("_packing_state"))
    if getattr(state, "path", None) != path:
        state.path, state.encoder = path, Encoder(path)
    return state.encoder


def _pieces(path: str | None, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode, end = _encoder(path or public_tokenizers.path("byte_bpe_50k.json")).encode, array.array("I", [END]).tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity  # the first piece is the shorter one
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if k == 0 else capacity
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            taken = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken[:, 0])), pa.array(taken[:, 1].astype(np.int32)), *(pa.array(taken[:, k]) for k in (2, 3, 4))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


class Capacities:
    """A segment tree over remaining capacities; a leaf has the runs of open sequences with that much left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.size)  # runs below each node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, by: int) -> None:
        node = left + self.size
        while node:
            self.held[node] += by
            node //= 2

    def push(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.runs[left].append((first, n))
            self._add(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self._add(left, -1)
        return self.runs[left].pop()

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of ``length`` or more that any open sequence has."""
        node = length + self.size
        if self.held[node]:
            return length
        while node > 1:  # up to the first right neighbour that holds something, then down to its left
            if node % 2 == 0 and self.held[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.held[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length.

    Rows are (length, first rank, items in a sequence, first sequence, offset): from that rank on, items
    go in groups of that number into sequences from that one on, behind that offset.
    """
    open_, rows, sequences = Capacities(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                open_.push(capacity, sequences, n)
                sequences, room = sequences + n, capacity
            first, n = open_.pop(room)
            each = room // length  # the tightest sequence stays the tightest until no item fits
            full = min(n, left // each)
            if full:
                rows.append((length, rank, each, first, capacity - room))
                open_.push(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                rows.append((length, rank, left, first + full, capacity - room))
                open_.push(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            open_.push(room, first + full, n - full)
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text) and their places.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. ``path`` is
    the tokenizer's file, as workers see it; by default the public byte-level one. Null and empty texts are one end token. Rows that repeat a
    doc_id are packed as often as they stand; a null doc_id is kept; an
    empty table gives no rows; other columns are ignored.
    """
    ship_by_value()
    pieces = staged(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    planned = plan(counts, capacity)
    keys = np.array([(r[0] << 44) + r[1] for r in planned], np.int64)
    order = np.argsort(keys)
    keys, table = keys[order], np.array(planned, np.int64).reshape(-1, 5)[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(table) else table[:0]
            index = rank - row[:, 1]
            sequence, offset = row[:, 3] + index // row[:, 2], row[:, 4] + index % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    cells = max(1, max(counts.values(), default=0) // CELL)
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("cell") / PART))
    parts = sizes.groupBy("length", "part").agg(F.sum("n").alias("n")).select("length", "part", before(Window.partitionBy("length").orderBy("part"), "n").alias("part_before"))
    starts = sizes.withColumn("before", before(Window.partitionBy("length", "part").orderBy("cell"), "n")).join(parts, ["length", "part"])
    starts = starts.select("length", "cell", (F.col("before") + F.col("part_before")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("inside", inside).join(starts, ["length", "cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
