"""Bloom filters of 64-bit hashes, made by tasks as parts that merge in any order.

A part is a set of rows (shard, once, twice): the bits of hashes that were seen,
and of those that were seen twice. Parts merge by OR; a bit that two parts have
in ``once`` is also set in ``twice``, so no hash that came twice is ever missing
there, whichever parts it came in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a shard, the unit in which parts travel and merge.
SHARD = 1 << 20
#: Bits of a filter at most (64 MB): what a task gets by broadcast has this bound, however large the input is.
MOST_BITS = 1 << 29
#: Hashes that a task holds before it hands on a part.
PART = 4_000_000

SCHEMA = "shard long, once binary, twice binary"


def filter_bits(n: int, each: int = 8, most: int = MOST_BITS) -> int:
    """Bits for n hashes: ``each`` of them or more, a power of two, within the bound."""
    return max(SHARD, min(most, 1 << max(0, n * each - 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of each hash, one after the other."""
    mask = np.uint64(bits - 1)
    return np.concatenate([hashes & mask, hashes >> np.uint64(32) & mask])


def _stored(at: np.ndarray) -> bytes:
    """Places in a shard, as a bit map or as a list, whichever is shorter."""
    if not len(at):
        return b""
    if 4 * len(at) < SHARD // 8:
        return b"L" + at.astype("<u4").tobytes()
    bits = np.zeros(SHARD, np.uint8)
    bits[at] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def _read(stored: bytes) -> np.ndarray:
    """The shard's bit map."""
    if stored[:1] == b"B":
        return np.frombuffer(stored, np.uint8, offset=1)
    out = np.zeros(SHARD, np.uint8)
    out[np.frombuffer(stored[1:], "<u4")] = 1
    return np.packbits(out, bitorder="little")


def part(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """The rows of a part that has seen these hashes."""
    seen, counts = np.unique(hashes, return_counts=True)
    once, twice = np.unique(places(seen, bits)), np.unique(places(seen[counts > 1], bits))
    shards = np.unique(once // np.uint64(SHARD))
    cuts = [np.searchsorted(x, np.append(shards, shards[-1:] + np.uint64(1)) * np.uint64(SHARD)) for x in (once, twice)]
    columns = [[_stored(x[a:b] % np.uint64(SHARD)) for a, b in zip(cut[:-1], cut[1:], strict=True)] for x, cut in zip((once, twice), cuts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int64)), *[pa.array(c, pa.binary()) for c in columns]], ["shard", "once", "twice"])


def parts(hashes: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Parts of a stream of arrays of hashes, each array with distinct ones."""
    held, size = [], 0
    for own in hashes:
        if len(own):
            held.append(own)
            size += len(own)
        if size >= PART:
            yield part(np.concatenate(held), bits)
            held, size = [], 0
    if size:
        yield part(np.concatenate(held), bits)


def merged(table: DataFrame) -> DataFrame:
    """Rows (shard, once, twice) as bit maps, one for each shard.

    Shards are dealt to tasks and stream by, one bit map of each kind in memory;
    how many parts a shard has does not matter.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = once = twice = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], ["shard", "once", "twice"])
        for batch in batches:
            for shard, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if at is not None:
                        yield row()
                    at, once, twice = shard, np.zeros(SHARD // 8, np.uint8), np.zeros(SHARD // 8, np.uint8)
                new = _read(a)
                twice |= once & new
                once |= new
                if b:
                    twice |= _read(b)
        if at is not None:
            yield row()

    return table.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, SCHEMA)


def collected(spark: SparkSession, shards: DataFrame, column: str, bits: int):
    """A broadcast of one kind of bit map, of ``bits`` bits."""
    whole = np.zeros(bits // 8, np.uint8)
    for r in shards.select("shard", column).collect():  # bits bound it
        at = r["shard"] * (SHARD // 8)
        whole[at : at + SHARD // 8] = np.frombuffer(r[column], np.uint8)
    return spark.sparkContext.broadcast(whole)


def lit(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of these bits is set."""
    return (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def holds(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is, or may be, in the filter."""
    found = lit(filled, places(hashes, 8 * len(filled)))
    return found[: len(hashes)] & found[len(hashes) :]


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def filter_of(rows: DataFrame, columns: list[str], hashed: Callable[..., int], each: int = 16):
    """A broadcast filter of a hash of some columns of a saved table."""
    bits = filter_bits(rows.count(), each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (np.unique(np.fromiter(map(hashed, *(c.to_pylist() for c in b.columns)), np.uint64, b.num_rows)) for b in batches)
        yield from parts(own, bits)

    return collected(rows.sparkSession, merged(rows.select(*columns).mapInArrow(run, SCHEMA)), "once", bits)


COUNTED = "shard long, places binary, counts binary"
MOST_COUNTED = 255


def counted_part(buckets: np.ndarray) -> pa.RecordBatch:
    """Rows (shard, places, counts) of how often each bucket occurs, up to ``MOST_COUNTED``."""
    found, counts = np.unique(buckets, return_counts=True)
    counts = np.minimum(counts, MOST_COUNTED).astype(np.uint8)
    shards = np.unique(found // SHARD)
    cuts = np.searchsorted(found, np.append(shards.astype(np.uint64), np.uint64(shards[-1]) + np.uint64(1)) * np.uint64(SHARD)).tolist()
    pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
    columns = [[(found[a:b] % SHARD).astype("<u4").tobytes() for a, b in pieces], [counts[a:b].tobytes() for a, b in pieces]]
    return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int64)), *[pa.array(c, pa.binary()) for c in columns]], ["shard", "places", "counts"])


def often(table: DataFrame, least: int) -> DataFrame:
    """Bit maps (shard, once) of the buckets that occur ``least`` times or more (``MOST_COUNTED`` at most) in all parts together."""
    least = min(least, MOST_COUNTED)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = total = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], ["shard", "once"])
        for batch in batches:
            for shard, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if at is not None:
                        yield row()
                    at, total = shard, np.zeros(SHARD, np.uint16)
                own = np.frombuffer(places, "<u4")
                total[own] = np.minimum(total[own] + np.frombuffer(counts, np.uint8), MOST_COUNTED)
        if at is not None:
            yield row()

    return table.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "shard long, once binary")
