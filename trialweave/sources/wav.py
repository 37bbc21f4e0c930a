"""WAV files as rows: their bytes, and waveforms in arrays.

Whole numbers of 8 (unsigned), 16, 24 and 32 bits and floats of 32 and 64 bits are read and written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.session import ship_by_value
from trialweave.sources.arrays import arrays, lists

#: Format tags of whole numbers, of floats, and of a header that has the tag further on.
_WHOLE, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of a folder's WAV files, not of its subfolders'; order by path where order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")


def _samples(data: bytes, tag: int, bits: int) -> np.ndarray:
    """Samples between -1 and 1 from their bytes."""
    if tag == _FLOAT:
        return np.frombuffer(data, {32: "<f4", 64: "<f8"}[bits]).astype(np.float64)
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:  # as the upper bytes of 32 bits
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return wide.view("<i4")[:, 0] / 2.0**31
    return np.frombuffer(data, {16: "<i2", 32: "<i4"}[bits]) / 2.0 ** (bits - 1)


def _parts(content: bytes) -> dict[bytes, bytes]:
    """The chunks of a file, by name; the last may be cut short."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    found, at = {}, 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        found.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def _read(content: bytes | None) -> tuple[np.ndarray | None, int | None, float]:
    """Mono samples, rate and seconds; none, none and 0.0 for what can't be read."""
    try:
        parts = _parts(content)
        tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
        if tag == _EXTENSIBLE:
            tag = struct.unpack_from("<H", parts[b"fmt "], 24)[0]
        if tag not in (_WHOLE, _FLOAT) or block != channels * bits // 8:
            raise ValueError("a format that isn't known")
        data = parts[b"data"]
        pcm = _samples(data[: len(data) // block * block], tag, bits).reshape(-1, channels)
        return pcm.mean(axis=1).astype(np.float32), rate, len(pcm) / rate
    except Exception:  # noqa: BLE001  any unreadable file has no duration
        return None, None, 0.0


def decoded(files: DataFrame) -> DataFrame:
    """path, sample_rate, duration_sec and pcm of ``files`` (path, content), channels mixed down.

    A file that can't be read has null pcm and a duration of 0.0.
    """
    ship_by_value()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.float64()), lists(f[0] for f in found)], names=["path", "sample_rate", "duration_sec", "pcm"])

    return files.select("path", "content").mapInArrow(read, "path string, sample_rate int, duration_sec double, pcm array<float>")


def kernel(rate: int, target: int, width: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, int, int, int]:
    """Low-pass filters, a row for each phase, to resample by windowed sinc; the two rates in lowest terms and the reach."""
    common = np.gcd(rate, target)
    rate, target = rate // common, target // common
    cutoff = min(rate, target) * rolloff
    reach = int(np.ceil(width * rate / cutoff))
    at = np.arange(-reach, reach + rate) / rate
    t = np.clip((at[None, :] - np.arange(target)[:, None] / target) * cutoff, -width, width)
    window = np.cos(t * np.pi / width / 2) ** 2
    return np.sinc(t) * window * cutoff / rate, rate, target, reach


def resampled(waveforms: DataFrame, target: int) -> DataFrame:
    """``waveforms`` (path, sample_rate, pcm) at another rate: path, sample_rate and pcm; null stays null."""
    ship_by_value()

    def one(pcm: np.ndarray, rate: int) -> np.ndarray:
        if rate == target or not len(pcm):
            return pcm
        filters, old, new, reach = kernel(rate, target)
        padded = np.pad(pcm.astype(np.float64), (reach, reach + old))
        starts = np.arange(0, len(pcm) + old, old)
        padded = np.pad(padded, (0, max(0, starts[-1] + filters.shape[1] - len(padded))))
        blocks = np.lib.stride_tricks.sliding_window_view(padded, filters.shape[1])[starts]
        return (blocks @ filters.T).reshape(-1)[: -(-len(pcm) * new // old)].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), arrays(batch.column(2)), strict=True)
            found = [None if pcm is None else one(pcm, rate) for rate, pcm in rows]
            rates = [None if x is None else target for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates, pa.int32()), lists(found)], names=["path", "sample_rate", "pcm"])

    return waveforms.select("path", "sample_rate", "pcm").mapInArrow(run, "path string, sample_rate int, pcm array<float>")


def _bytes_of(pcm: np.ndarray, bits: int, floats: bool) -> bytes:
    if floats:
        return pcm.astype({32: "<f4", 64: "<f8"}[bits]).tobytes()
    full = 2.0 ** (bits - 1)
    whole = np.clip(np.rint(pcm.astype(np.float64) * full), -full, full - 1).astype("<i8")
    if bits == 8:
        return (whole + 128).astype(np.uint8).tobytes()
    return np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8)[:, : bits // 8]).tobytes()


def encoded(waveforms: DataFrame, rate: int, bits: int = 16, floats: bool = False) -> DataFrame:
    """path and content: ``waveforms`` (path, pcm) as mono WAV files, whole numbers clipped at full scale; null for null."""
    if bits not in ((32, 64) if floats else (8, 16, 24, 32)):
        raise ValueError(f"no samples of {bits} bits")
    ship_by_value()

    def one(pcm: np.ndarray) -> bytes:
        data, block = _bytes_of(pcm, bits, floats), bits // 8
        head = struct.pack("<4sIHHIIHH", b"fmt ", 16, _FLOAT if floats else _WHOLE, 1, rate, rate * block, block, bits)
        body = head + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
        return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [None if x is None else one(x) for x in arrays(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    return waveforms.select(F.col("path"), F.col("pcm").cast("array<float>")).mapInArrow(write, "path string, content binary")
