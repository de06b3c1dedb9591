"""Coordinate text as a data source: ``spark.read.format("matrix_market")`` and ``df.write.format("matrix_market")``.

A matrix is a file, or a folder that this source wrote: parts of entries, and a head
that names them with their rows. Tasks write parts, and the head is written once all
of them have: before that, and for ever if a task failed, the folder is no matrix.
Paths are URIs of file systems that ``pyarrow.fs`` knows, or local paths.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Bytes of a partition, bytes of it that are held at once, and entries of a batch.
SPLIT, CHUNK, BATCH = 32 << 20, 1 << 20, 100_000
HEAD = "head.json"
KINDS = {"real": 3, "integer": 3, "pattern": 2}


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    """Bytes [start, stop) of a file of entries; the entry that begins in them belongs to it."""

    path: str
    start: int
    stop: int
    width: int


class MarketReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.low, self.high = path, split, 0, (1 << 62)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes ranges of rows; all else is left to Spark."""
        for f in filters:
            if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.attribute != ("i",):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))

    def partitions(self) -> list[Split]:
        """Splits of the file, or of those parts that hold rows of the range."""
        from pyarrow import fs

        system, path = _file_system(self.path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            try:
                with system.open_input_stream(f"{path}/{HEAD}") as f:
                    head = json.loads(f.read())
            except FileNotFoundError:
                raise ValueError(f"{self.path} holds no whole matrix") from None
            files = [(f"{path}/{p['name']}", 0, 3) for p in head["parts"] if p["low"] <= self.high and p["high"] >= self.low]
        else:
            files = [(path, *self._body(system, path))]
        found = []
        for name, start, width in files:
            size = system.get_file_info(name).size
            found += [Split(name, at, min(at + self.split, size), width) for at in range(start, size, self.split)]
        return found

    @staticmethod
    def _body(system, path: str) -> tuple[int, int]:
        """Where the entries begin, and the words of each."""
        with io.BufferedReader(system.open_input_file(path)) as f:
            lines = iter(f.readline, b"")
            words = next(lines, b"").decode().lower().split()
            if len(words) != 5 or words[:3] != ["%%matrixmarket", "matrix", "coordinate"] or words[3] not in KINDS or words[4] != "general":
                raise ValueError(f"not supported: {' '.join(words)}")
            for line in lines:
                if line.strip() and not line.startswith(b"%"):
                    return f.tell(), KINDS[words[3]]
        raise ValueError("no sizes")

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        with io.BufferedReader(system.open_input_file(partition.path)) as f:
            # a line that began before belongs to the split before
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()
            while (at := f.tell()) < partition.stop and (data := f.read(min(CHUNK, partition.stop - at))):
                yield from self._entries(data if data.endswith(b"\n") else data + f.readline(), partition)

    def _entries(self, data: bytes, partition: Split) -> Iterator[pa.RecordBatch]:
        """The entries of whole lines that are rows of the range."""
        words = data.split()
        if len(words) % partition.width:
            raise ValueError(f"malformed entries in {partition.path}")
        i = np.array(words[:: partition.width]).astype(np.int64) - 1
        j = np.array(words[1 :: partition.width]).astype(np.int64) - 1
        v = np.array(words[2 :: partition.width]).astype(np.float64) if partition.width == 3 else np.ones(len(i))
        own = np.flatnonzero((i >= self.low) & (i <= self.high))
        for at in range(0, len(own), BATCH):
            rows = own[at : at + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (i, j, v)], ["i", "j", "v"])


@dataclass
class Part(WriterCommitMessage):
    name: str
    n: int
    low: int
    high: int


class MarketWriter(DataSourceWriter):
    def __init__(self, path: str, m: int, n: int):
        self.path, self.m, self.n = path, m, n

    def write(self, rows: Iterator) -> Part:
        """One part of entries, as they come."""
        system, path = _file_system(self.path)
        system.create_dir(path, recursive=True)
        name, n, low, high = f"part-{uuid.uuid4().hex}", 0, 1 << 62, -1
        with system.open_output_stream(f"{path}/{name}") as f:
            for i, j, v in rows:
                if not (0 <= i < self.m and 0 <= j < self.n):
                    raise ValueError(f"entry ({i}, {j}) is not in a matrix of {self.m} x {self.n}")
                f.write(b"%d %d %.17g\n" % (i + 1, j + 1, v))
                n, low, high = n + 1, min(low, i), max(high, i)
        return Part(name, n, low, high)

    def commit(self, messages: list[Part | None]) -> None:
        """The head, which makes the parts a matrix."""
        system, path = _file_system(self.path)
        parts = [vars(p) for p in messages if p is not None and p.n]
        head = {"m": self.m, "n": self.n, "nnz": sum(p["n"] for p in parts), "parts": parts}
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/.{HEAD}") as f:
            f.write(json.dumps(head).encode())
        system.move(f"{path}/.{HEAD}", f"{path}/{HEAD}")

    def abort(self, messages: list[Part | None]) -> None:
        system, path = _file_system(self.path)
        for p in messages:
            if p is not None:
                system.delete_file(f"{path}/{p.name}")


class MarketSource(DataSource):
    """Options: ``path``; to write also ``m`` and ``n``, the numbers of rows and columns; ``split``, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "matrix_market"

    def schema(self) -> str:
        return "i long, j long, v double"

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> MarketWriter:
        if overwrite:
            raise ValueError("matrices are written to a new path, in mode append")
        return MarketWriter(self.options["path"], int(self.options["m"]), int(self.options["n"]))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take filters of rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MarketSource)
