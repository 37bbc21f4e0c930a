"""WAV files read by range: headers alone, or blocks of samples.

``spark.dataSource`` knows this as ``wavscan``. The driver lists names and sizes. Tasks get byte ranges of about ``split`` bytes, of
one large file or of many small ones; they read a file's chunk headers, and of its samples
only the blocks that begin in their range. Without ``pcm`` no sample is read. Beyond 256 tasks smaller shares than 16 MB grow up to that size.

Options: ``path`` (a folder, whose own WAV files are meant, or a file), ``deep`` (those of folders in it too), ``pcm``, ``samples`` (in a block) and ``split``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from trialweave.session import ship_by_value
from trialweave.sources.arrays import lists
from trialweave.sources.trees import opened
from trialweave.sources.wav import _EXTENSIBLE, _FLOAT, _WHOLE, _samples

#: Samples of a block, bytes of a task's share, what a file counts at least, tasks with shares below ``SPLIT``, and blocks and samples of a batch.
SAMPLES, SPLIT, LEAST, TASKS, ROWS, BATCH = 65_536, 16 << 20, 16 << 10, 256, 4096, 1 << 20
_HEADERS = "path string, sample_rate int, channels int, bits int, n_samples long, duration_sec double"
_BLOCKS = _HEADERS + ", block int, start long, pcm array<float>"
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]


@dataclass
class Format:
    """What a file's header says, and where its samples are."""

    tag: int
    channels: int
    rate: int
    bits: int
    at: int
    n: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8


def header(file: pa.NativeFile) -> Format | None:
    """The format of an open file, from its chunk headers; none for what can't be read. The samples may be cut short."""
    try:
        end = file.size()
        head = file.read(12)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            return None
        at, form, data = 12, None, None
        while at + 8 <= end and not (form and data):
            file.seek(at)
            name, size = struct.unpack("<4sI", file.read(8))
            if name == b"fmt " and form is None:
                form = file.read(min(size, 64))
            elif name == b"data" and data is None:
                data = at + 8, min(size, end - at - 8)
            at += 8 + size + size % 2
        tag, channels, rate, _, width, bits = struct.unpack_from("<HHIIHH", form)
        if tag == _EXTENSIBLE:
            tag = struct.unpack_from("<H", form, 24)[0]
        if tag not in (_WHOLE, _FLOAT) or bits not in ((32, 64) if tag == _FLOAT else (8, 16, 24, 32)) or width != channels * bits // 8 or not width or not rate:
            return None
        return Format(tag, channels, rate, bits, data[0], data[1] // width)
    except (OSError, TypeError, struct.error):
        return None


@dataclass
class Share(InputPartition):
    """Byte ranges (path, from, to) of files."""

    ranges: list[tuple[str, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, path: str, deep: bool, pcm: bool, samples: int, split: int) -> None:
        self.path, self.deep, self.pcm, self.samples, self.split = path.rstrip("/"), deep, pcm, samples, split

    def _files(self) -> tuple[fs.FileSystem, str]:
        return opened(self.path)

    def partitions(self) -> list[Share]:
        files, base = self._files()
        one = files.get_file_info(base)
        found = [one] if one.type == fs.FileType.File else [x for x in files.get_file_info(fs.FileSelector(base, recursive=self.deep)) if x.type == fs.FileType.File and x.path.endswith(".wav")]
        counts = lambda n: max(LEAST, n) if self.pcm else LEAST
        most = max(self.split, min(SPLIT, sum(counts(x.size) for x in found) // TASKS))
        shares, held, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            end = max(x.size, 1)
            step = self.split if self.pcm else end
            for a in range(0, end, step):
                b = min(a + step, end)
                if held and held[-1][0] == x.path:
                    held[-1] = (x.path, held[-1][1], b)
                else:
                    held.append((x.path, a, b))
                size += counts(b - a)
                if size >= most:
                    shares.append(Share(held))
                    held, size = [], 0
        return [*shares, Share(held)] if held or not shares else shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, base = self._files()
        headers, rows, held, size = [], [], [], 0
        for path, a, b in partition.ranges:
            shown = path if self.path == base else self.path.removesuffix(base) + path
            with files.open_input_file(path) as file:
                form = header(file)
                known = (shown, form.rate, form.channels, form.bits, form.n, form.n / form.rate) if form else (shown, None, None, None, None, 0.0)
                if not self.pcm:
                    headers.append(known)
                    continue
                for k, pcm in self._blocks(file, form, a, b):
                    rows.append((*known, k, k * self.samples))
                    held.append(pcm)
                    size += 0 if pcm is None else len(pcm)
                    if size >= BATCH or len(rows) >= ROWS:
                        yield self._batch(rows, held)
                        rows, held, size = [], [], 0
        if headers or rows:
            yield self._batch(headers or rows, held if self.pcm else None)

    def _blocks(self, file: pa.NativeFile, form: Format | None, a: int, b: int) -> Iterator[tuple[int, np.ndarray | None]]:
        """The blocks that begin between ``a`` and ``b``; without samples, one that is empty or null."""
        if form is None or not form.n:
            if a == 0:
                yield 0, np.empty(0, np.float32) if form else None
            return
        step = self.samples * form.width
        first, last = max(0, -(-(a - form.at) // step)), min(-(-form.n // self.samples), -(-(b - form.at) // step))
        for k in range(first, last):
            file.seek(form.at + k * step)
            n = min(self.samples, form.n - k * self.samples)
            yield k, _samples(file.read(n * form.width), form.tag, form.bits).reshape(-1, form.channels).mean(axis=1).astype(np.float32)

    def _batch(self, rows: list[tuple], pcm: list[np.ndarray | None] | None) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=False)]
        names = [x.split()[0] for x in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([*columns, lists(pcm)] if pcm is not None else columns, names=names if pcm is not None else names[: len(columns)])


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wavscan"

    def _is(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"

    def schema(self) -> str:
        return _BLOCKS if self._is("pcm") else _HEADERS

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options["path"], self._is("deep"), self._is("pcm"), int(self.options.get("samples", SAMPLES)), int(self.options.get("split", SPLIT)))


def _scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    ship_by_value()
    spark.dataSource.register(WavSource)
    return spark.read.format("wavscan").options(path=path, **options).load()


def wav_headers(spark: SparkSession, path: str, deep: bool = False, split: int = SPLIT) -> DataFrame:
    """path, sample_rate, channels, bits, n_samples and duration_sec of each file, without its samples.

    A file that can't be read has nulls and a duration of 0.0.
    """
    return _scan(spark, path, deep=str(deep), split=str(split))


def wav_blocks(spark: SparkSession, path: str, samples: int = SAMPLES, split: int = SPLIT) -> DataFrame:
    """The same with block, start and pcm: each file's samples, mixed down, in blocks of ``samples``.

    A file without samples has one empty block, one that can't be read a block that is null.
    """
    return _scan(spark, path, pcm="true", samples=str(samples), split=str(split))
