"""Substring deduplication by sliding sentence spans.

A span is a run of consecutive sentences of ``least`` words or more that has none
shorter from its first sentence on, or none shorter up to its last; one long
sentence is a span, too. Spans are hashed; hashes are joined over the whole corpus;
sentences that any non-first occurrence of a repeated span covers are removed. So
whole sentences that repeat together go wherever they stand, if they have ``least``
words. A document of fewer words is one span of all it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, forget, ranked, restored, saved, text_of
from .tokenization import text_slices

#: Words of a span at least, far fewer than the 50 of a passage, which may be cut within its first and last sentence.
LEAST = 15
#: Spans with more places than this, and than a hundred-thousandth of all places, are broadcast: 100,000 rows of 40 bytes at most.
HOT_PLACES = 1000
HOT_SPANS = 100_000
#: A sentence with the blanks behind it: up to closing marks followed by a blank, or a line end. End marks not followed
#: by a blank, closing marks or not, are ordinary characters, so no character of a word is a sentence of its own.
SENTENCE = re.compile(r"\S(?:[^.!?\n]++|[.!?]++[\"')\]]*+(?!\s|\Z))*+(?:[.!?]+[\"')\]]*)?\s*|\s+")
SHORT = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Character ranges that tile ``text``."""
    return [m.span() for m in SENTENCE.finditer(text)]


def sentence_key(sentence: str) -> str:
    """What is compared: words in lower case."""
    return " ".join(SHORT.findall(sentence.lower()))


def spans_in(sizes: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges (start, stop) of the spans of sentences with these numbers of words, each at least 1."""
    if sum(sizes) < least:
        return [(0, len(sizes))] if sizes else []
    found, start, held = set(), 0, 0
    for stop, size in enumerate(sizes, 1):
        held += size
        if held >= least:
            while held - sizes[start] >= least:
                # the shortest from ``start`` on has ended before
                held -= sizes[start]
                start += 1
            found.add((start, stop))
    stop = held = 0
    for start, size in enumerate(sizes):
        while held < least and stop < len(sizes):
            held += sizes[stop]
            stop += 1
        if held < least:
            break
        found.add((start, stop))
        held -= size
    return sorted(found)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # rows that repeat id and text are one document; a repeated id with another text is another document
    text = text_of(text_col)
    rank = ranked(id_col, docs.schema[id_col].dataType)
    return docs.select(carried(id_col).alias("id"), rank.alias("rank"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))


def spans_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (h1, h2, rank, key, at, width): one per span of a keyed document, ``at`` its first sentence.

    h1 and h2 are 96 bits of the hash, which keeps the exchanges small.
    """
    schema = T.StructType(
        [T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType())]
        + [T.StructField("rank", docs.schema["rank"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("key", "at", "width")]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        for pdf in batches:
            ranks, keys, texts = pdf["rank"].tolist(), pdf["key"].tolist(), pdf["text"].tolist()
            for lo, hi in text_slices(texts):
                digests, owners, own_keys, ats, widths = [], [], [], [], []
                for doc, key, text in zip(ranks[lo:hi], keys[lo:hi], texts[lo:hi], strict=True):
                    # sentences without a word are carried by their neighbours
                    found = [(i, k) for i, (a, b) in enumerate(sentences(text)) if (k := sentence_key(text[a:b]))]
                    for start, stop in spans_in([k.count(" ") + 1 for _, k in found], least):
                        part = found[start:stop]
                        digests.append(xxhash.xxh3_128_digest("\n".join(k for _, k in part)))
                        ats.append(part[0][0])
                        widths.append(part[-1][0] - part[0][0] + 1)
                        owners.append(doc)
                        own_keys.append(key)
                halves = np.frombuffer(b"".join(digests), dtype=[("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")])
                yield pd.DataFrame({"h1": halves["h1"], "h2": halves["h2"], "rank": owners, "key": own_keys, "at": ats, "width": widths})

    return docs.select("rank", "key", "text").mapInPandas(run, schema)


def repeated_sentences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Written rows (rank, key, ranges): for each keyed document the spans (at, width) that an earlier place has too."""
    spans = saved(spans_of(docs, least), "all-spans")  # read again, cut from the texts once
    # partial sums make a span that is everywhere one row per task
    firsts = spans.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("rank", "key", "at")).alias("first"))
    firsts = saved(firsts.where("n > 1"), "first-spans")
    limit = max(HOT_PLACES, spans.count() // HOT_SPANS)
    hot, rest = F.broadcast(firsts.where(F.col("n") > limit)), firsts.where(F.col("n") <= limit)
    # places of a span that is everywhere never meet in one task
    later = spans.join(hot, ["h1", "h2"]).unionByName(spans.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    # no place is before the first, so another one is a later one
    later = later.where(~F.struct("rank", "key", "at").eqNullSafe(F.col("first")))
    # of a document at most its own spans meet here
    ranges = saved(later.groupBy("rank", "key").agg(F.collect_set(F.struct("at", "width")).alias("ranges")), "spans")
    forget(spans, firsts)
    return ranges


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (id, n_sentences, n_removed, removed(array of start, stop), text): text without repeated spans.

    The first occurrence, by id and then place, stays. Null text is empty. Rows
    that repeat id and text count as one document and are cut alike; null ids
    come first, and of ties of ids that with the smaller key. Other columns are ignored; an empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    marks = repeated_sentences(keyed, least).withColumnsRenamed({"rank": "rank_", "key": "key_"})
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, T.StringType()),
            T.StructField("n_sentences", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
            T.StructField("text", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, ranges in zip(pdf["id"].tolist(), pdf["text"].tolist(), pdf["ranges"].tolist(), strict=True):
                tiles = sentences(text)
                gone = {i for r in (ranges if ranges is not None else ()) for i in range(r["at"], r["at"] + r["width"])}
                runs: list[list[int]] = []
                for i in sorted(gone):
                    if runs and runs[-1][1] == tiles[i][0]:
                        runs[-1][1] = tiles[i][1]
                    else:
                        runs.append(list(tiles[i]))
                kept = "".join(text[a:b] for i, (a, b) in enumerate(tiles) if i not in gone)
                rows.append((doc, len(tiles), len(gone), [{"start": a, "stop": b} for a, b in runs], kept))
            yield pd.DataFrame(rows, columns=schema.names)

    both = keyed.join(marks, F.expr("key = key_ and rank <=> rank_"), "left").select("id", "text", "ranges")
    return both.mapInPandas(cut, schema).withColumn(id_col, restored(id_col, kind))
