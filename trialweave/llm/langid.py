"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with text of
that language. A document is compressed with every dictionary, in pieces short enough that the
dictionary matters in each, and gets the language of the smallest total. Where
the next one is nearly as small, the prediction is marked as not accepted.

The dictionaries are the only thing learned. They come from a bounded sample:
the ``DOCS`` labelled documents of each language whose ids have the least digests, and from each
a passage of at most ``CHARS`` code points at a place that a digest chooses in the whole text. Each passage gives
an equal share of the ``DICTIONARY`` bytes, longer ones what shorter ones leave. Every whole
text is classified, in tasks that hold nothing but the dictionaries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import ship_by_value

#: The bounds of the sample, for each language.
DOCS, CHARS, DICTIONARY = 64, 400, 16384
LEVEL, PIECE = 5, 2000
#: Least relative margin for a prediction to be accepted.
MARGIN = 0.02
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def cleaned(text: str | None) -> bytes:
    """Lower-case letters of a text, words separated by single spaces; empty without letters."""
    found = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    return found.encode("utf-8", "surrogatepass") if any(map(str.isalpha, found)) else b""


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 modulo 5; so does a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def filled(passages: list[bytes]) -> bytes:
    """A dictionary of ``DICTIONARY`` bytes at most, to which each passage gives an equal share as far as it goes."""
    out, room = [], DICTIONARY
    for k, text in enumerate(sorted(passages, key=lambda p: (len(p), p))):
        share = max(0, room // (len(passages) - k) - 1)
        out.append(text[:share])
        room -= len(out[-1]) + 1
    return b" ".join(out)


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The dictionary of each language of the labelled documents that aren't held out.

    At most ``DOCS`` passages of each language come to the driver, however often ids repeat.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    length = F.length("text")
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.greatest(length - CHARS + 1, F.lit(1)))
    passage = F.substring("text", (place + 1).cast("int"), F.lit(CHARS))
    rows = known.select("lang", F.xxhash64(F.lit(5), "doc_id").alias("digest"), passage.alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "text"))  # Spark keeps only so many in each task
    found: dict[str, list[bytes]] = {}
    for row in rows.withColumn("place", least).where(F.col("place") <= DOCS).collect():
        found.setdefault(row["lang"], []).append(cleaned(row["text"]))
    return {lang: filled([t for t in texts if t]) for lang, texts in found.items()}


def classifier(dictionaries: dict[str, bytes]) -> Callable[[str | None], tuple[str, float]]:
    """A function from a text to its language and relative margin."""
    kinds = {lang: zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for lang, data in sorted(dictionaries.items())}
    for kind in kinds.values():
        kind.precompute_compress(level=LEVEL)
    tools = {lang: zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=False, write_content_size=False, write_dict_id=False) for lang, kind in kinds.items()}

    def predict(text: str | None) -> tuple[str, float]:
        data = cleaned(text)
        if not data or not tools:
            return UNKNOWN, 0.0
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(tool.compress(p)) for p in pieces), lang) for lang, tool in tools.items())
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0

    return predict


def language_id(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every row of ``docs`` (doc_id, text, lang).

    The language is one of those learned, by name if sizes tie, or ``und`` for a text
    that is null or has no letter, and for all if nothing was learned. ``score`` is
    the relative margin over the next language; ``accepted`` needs ``MARGIN``.
    Rows with a null language are classified but teach nothing; those with a null
    doc_id are held out; repeated rows get the same result; an empty table gives no
    rows; other columns are ignored.
    """
    ship_by_value()
    known = learn(docs) if dictionaries is None else dictionaries

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = classifier(known)
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] >= MARGIN for f in found], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tag, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
