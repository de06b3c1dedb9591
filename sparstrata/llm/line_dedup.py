"""Line deduplication by two Bloom filters.

Tasks hash the lines of their documents, each hash once a document, into parts
of two filters: of hashes seen once, and seen twice. The merged filter of those
seen twice goes back to all tasks. Only documents with a line that it holds,
and of them only digests of such lines, are shuffled: digests are counted
exactly, and the lines of those that are frequent go, or all of them but the first.

The filter's size follows the number of lines up to ``bloom.MOST_BITS``. Beyond
that more lines are suspected than are repeated; they are counted exactly all the
same, so results never depend on the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import saved, text_of

#: What is stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: Digests of more than a hundred-thousandth of all suspected lines: at most so many, whatever the input.
HOT_SHARE = 100_000


def key_of(line: bytes) -> bytes:
    """A line without blanks at its ends, ASCII letters in lower case."""
    return line.strip(BLANKS).lower()


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(bloom.hash_of, keys), np.uint64, len(keys))


def _shortest(key: bytes, least: int) -> bool:
    return len(key) >= least and (least < 2 or len(key.decode("utf-8", "replace")) >= least)


def twice_seen(texts: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """Bit maps (shard, once, twice) of the keys of texts(text), a key once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (_hashes([k for k in {key_of(x) for x in text.split(b"\n")} if _shortest(k, least)]) for b in batches for text in b.column(0).to_pylist())
        yield from bloom.parts(own, bits)

    return bloom.merged(texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, bloom.SCHEMA))


def _suspected(rows: DataFrame, seen, least: int, whole: bool) -> DataFrame:
    """(uid, id, n_lines, sha, text, keys, lines): digests of suspected keys and, for each, its lines; the text where there is one, or always if ``whole``."""
    schema = T.StructType(
        [
            *rows.select("uid", "id").schema.fields,
            T.StructField("n_lines", T.LongType()),
            T.StructField("sha", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("keys", T.ArrayType(T.BinaryType())),
            T.StructField("lines", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, shas, texts, keys, lines = [], [], [], [], []
            # keys of the whole batch are asked for at once
            cut = [[key_of(x) for x in text.split(b"\n")] for text in (t.as_py() for t in batch.column(2))]
            held = [list({k for k in own if _shortest(k, least)}) for own in cut]
            found = bloom.holds(seen.value, _hashes([k for own in held for k in own])).tolist()
            at = 0
            for text, own, asked in zip(batch.column(2), cut, held, strict=True):
                places = {k: [] for k, hit in zip(asked, found[at : at + len(asked)], strict=True) if hit}
                at += len(asked)
                if places:
                    for i, k in enumerate(own):
                        if k in places:
                            places[k].append(i)
                data = text.as_py()
                n_lines.append(len(own))
                shas.append(hashlib.sha256(data).hexdigest())
                texts.append(data.decode() if places or whole else None)
                keys.append([hashlib.sha256(k).digest()[:16] for k in places])
                lines.append(list(places.values()))
            columns = [pa.array(n_lines, pa.int64()), pa.array(shas), pa.array(texts, pa.string()), pa.array(keys, pa.list_(pa.binary())), pa.array(lines, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema.names)

    return rows.select("uid", "id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _without(rows: DataFrame) -> DataFrame:
    """(id, n_lines, n_dropped, sha, text) of rows (id, n_lines, text, gone), ``gone`` the places of lines that go."""
    kinds = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "sha": T.StringType(), "text": T.StringType()}
    schema = T.StructType([rows.schema["id"], *[T.StructField(c, kind) for c, kind in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_dropped, shas, texts = [], [], []
            for text, gone in zip(batch.column(2), batch.column(3), strict=True):
                lines, out = text.as_py().split("\n"), set(gone.as_py())
                kept = "\n".join(x for i, x in enumerate(lines) if i not in out)
                n_dropped.append(len(out))
                shas.append(hashlib.sha256(kept.encode()).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_dropped, pa.int64()), pa.array(shas), pa.array(texts, pa.string())], schema.names)

    return rows.select("id", "n_lines", "text", "gone").mapInArrow(run, schema)


def drop_lines(docs: DataFrame, min_docs: int = 2, least: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Rows (id, n_lines, n_dropped, kept_sha256[, text]): every document without the lines whose key ``min_docs`` documents or more have.

    Lines end at a line feed; a line's key is the line without blanks at its ends
    and with ASCII letters in lower case. Keys under ``least`` code points are left
    alone. With ``keep_first`` the first line of each such key stays, that of the
    smallest id (null ids first, then the order of rows) and smallest place.
    Null and empty texts are one empty line. Rows that repeat an id or a text
    are documents of their own; other columns are ignored; an empty table gives
    no rows. ``with_text=False`` spares the texts of untouched documents a copy.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    ends = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    n = texts.agg(F.coalesce(F.sum(ends.cast("long")), F.lit(0))).first()[0]
    bits = bloom.filter_bits(int(n))
    seen = bloom.collected(spark, twice_seen(texts, bits, least), "twice", bits)
    cut = saved(_suspected(texts.withColumn("uid", F.monotonically_increasing_id()), seen, least, with_text), "cut-lines")
    keys = cut.where(F.size("keys") > 0).select("uid", "id", F.explode(F.arrays_zip("keys", "lines")).alias("k")).select("uid", "id", F.col("k.keys").alias("key"), F.col("k.lines").alias("lines"))
    counted = keys.groupBy("key").agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "uid", F.col("lines")[0].alias("line"))).alias("first"))
    counted = counted.where(F.col("n_docs") >= min_docs).select("key", "n_docs", *([F.col("first.uid").alias("first_uid")] if keep_first else []))
    frequent = saved(counted, "frequent-lines")
    total = cut.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    # counts sum up to the total, so no more than HOT_SHARE digests pass; each of the others is a hundred-thousandth of the rows at most
    hot = F.broadcast(frequent.where(F.col("n_docs") > total / HOT_SHARE).withColumn("hot", F.lit(True)).drop("n_docs"))
    rare = frequent.where(F.col("n_docs") <= total / HOT_SHARE).drop("n_docs")
    marked = keys.drop("id").join(hot, "key", "left")
    found = marked.where("hot").drop("hot").unionByName(marked.where("hot is null").select("key", "uid", "lines").join(rare, "key"))
    lines = F.when(F.col("uid") == F.col("first_uid"), F.slice("lines", 2, F.greatest(F.lit(1), F.size("lines")))).otherwise(F.col("lines")) if keep_first else F.col("lines")
    gone = found.select("uid", lines.alias("lines")).groupBy("uid").agg(F.flatten(F.collect_list("lines")).alias("gone"))
    touched = cut.where(F.size("keys") > 0).join(gone, "uid", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    still = cut.where(F.size("keys") == 0).select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "sha", "text")
    found = still.unionByName(_without(touched))
    return found.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("sha").alias("kept_sha256"), *([F.col("text").alias(text_col)] if with_text else []))
