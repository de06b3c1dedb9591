"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces are dealt by length to pools of bounded size; each pool is packed by best-fit
decreasing. Dual-feasible functions give a lower bound on a pool's bins. A pool
that meets it is certified and final. Pools with a gap hand on documents of their
emptiest bins, and of bins of many small ones; the handed-on documents of ``fan_in`` neighbouring pools meet in
one pool of the next round, which packs them anew and keeps the better of the
two arrangements. Rounds go on until all pools are certified or one is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, restored, saved, text_of
from .tokenization import encoder, text_slices

CAPACITY = 1024
POOL_PIECES = 20_000
FAN_IN = 4


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    n_upto, s_upto = np.cumsum(count), np.cumsum(count * sizes)
    best = -(-int(s_upto[-1]) // capacity)
    # items over capacity - k count as whole bins, items under k not at all
    k = np.arange(1, capacity // 2 + 1)
    large = n_upto[-1] - n_upto[capacity - k]
    middle = s_upto[capacity - k] - s_upto[k - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    # items rounded down to multiples of 1 / m, exact multiples of 1 / (m + 1) kept
    for m in range(1, 33):
        whole, rest = np.divmod((m + 1) * sizes, capacity)
        scaled = np.where(rest == 0, whole * m, whole * (m + 1))  # in units of 1 / (m * (m + 1))
        best = max(best, -(-int((count * scaled).sum()) // (m * (m + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Open bins hang in one stack per free space."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            free, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(b)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """Rows (uid, id, piece, start, length, ids_crc32): each document encoded, ended, and cut if too long; ids as strings.

    The first piece takes what is over after whole pieces of ``capacity``.
    """
    schema = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )
    end = np.uint32(end_id).tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for lo, hi in text_slices(texts):
                rows = []
                for doc_id, got in zip(ids[lo:hi], encode(texts[lo:hi]), strict=True):
                    data = got + end
                    n = len(data) // 4
                    first = n % capacity or capacity
                    for piece, start in enumerate((0, *range(first, n, capacity))):
                        stop = first if piece == 0 else start + capacity
                        stop = min(stop, n)
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                yield pd.DataFrame(rows, columns=schema.names).astype({"piece": "int32"} | {c: "int64" for c in schema.names[2:]})

    pieces = docs.select(carried(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(cut, schema)
    return pieces.select(F.monotonically_increasing_id().alias("uid"), "*")


def _repacker(names: list[str], capacity: int, hand_on: int, turn: int, last: bool):
    """Packs one pool: keeps the better arrangement, certifies it, or opens its emptiest bins."""

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        count, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        held = pdf["sequence_id"].nunique() if turn else count + 1
        if count < held:
            pdf["sequence_id"] = bins + (turn << 56 | int(pdf["pool"].iloc[0]) << 24)
            pdf["offset"] = offsets
        else:
            count = held
            bins = pd.factorize(pdf["sequence_id"])[0]
        pdf["certified"] = count == bound
        pdf["open"] = False
        if count > bound and not last:
            sizes = np.bincount(bins, lengths)
            pieces = np.bincount(bins)
            # the emptiest bins, in turn with those of the most pieces, whose small documents fill gaps
            empty, many = np.argsort(sizes, kind="stable"), np.argsort(-pieces, kind="stable")
            turns = np.column_stack([empty, many]).reshape(-1)
            order = turns[np.sort(np.unique(turns, return_index=True)[1])]
            taken = order[np.cumsum(pieces[order]) <= hand_on]
            pdf["open"] = np.isin(bins, taken)
        return pdf[names]

    return repack


def pack(pieces: DataFrame, capacity: int = CAPACITY, pool_pieces: int = POOL_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``certified`` to pieces with columns uid and length.

    ``certified`` tells that the bound proves its pool's bins to be as few as possible.
    """
    names = pieces.columns
    pieces = saved(pieces, "pieces")
    pools = max(1, -(-pieces.count() // pool_pieces))
    # sorted by length and dealt in turn, so that all pools hold like mixtures of lengths
    dealt = pieces.repartitionByRange("length", "uid").sortWithinPartitions("length", "uid")
    live = dealt.select(
        "*",
        F.lit(None).cast("long").alias("sequence_id"),
        F.lit(None).cast("long").alias("offset"),
        F.lit(False).alias("certified"),
        F.lit(False).alias("open"),
        F.pmod(F.monotonically_increasing_id(), F.lit(pools)).alias("pool"),
    )
    live = saved(live, "pools")
    schema = live.schema
    hand_on = pool_pieces // fan_in
    done, turn = [], 0

    while True:
        last = pools == 1

        packed = saved(live.groupBy("pool").applyInPandas(_repacker(schema.names, capacity, hand_on, turn, last), schema), "packed")
        if last:
            done.append(packed)
            break
        done.append(packed.where(~F.col("open")))
        live = packed.where("open").withColumn("pool", F.floor(F.col("pool") / fan_in))
        if live.isEmpty():
            break
        pools, turn = -(-pools // fan_in), turn + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(*names, "sequence_id", "offset", "certified")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack ``docs``: one row per piece.

    Null text is empty and gives a piece of the end id alone. Null ids, repeated
    rows and ties are packed like others, each row by itself; other columns are
    ignored; an empty table gives no rows.
    """
    packed = pack(token_pieces(docs, tokenizer, id_col, text_col, capacity), capacity)
    return packed.select(restored("id", docs.schema[id_col].dataType).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
