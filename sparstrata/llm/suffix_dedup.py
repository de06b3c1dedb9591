"""Exact substring deduplication on enhanced suffix arrays.

A byte goes if a string of ``length`` bytes covers it that also starts earlier in
the corpus. Matching strings are brought together by anchors: in every window
of ``length`` bytes the q-gram of least hash, the leftmost of equals, which
depends on the window's content alone, so equal windows have equal anchors at
equal places. Neighbouring windows mostly share an anchor and form a run.

1. All anchors are range-partitioned and sorted by hash; those that occur once
   are dropped. Only hashes and places travel, not text.
2. Runs with a repeated anchor become contexts: their bytes and one before.
   Contexts meet in buckets by anchor.
3. A bucket sorts the suffixes of its contexts, computes common prefixes of
   neighbours, and scans the common-prefix interval tree with a stack. An
   interval of ``length`` or more whose left extensions differ is a maximal
   repeat group with all its occurrences; one with the same byte to the left
   everywhere lies in a longer group. All but the first occurrence of a group
   are covered.
4. Anchors with very many occurrences are salted: each share is scanned alike,
   and the windows that are first in their share meet once more. Some neighbouring
   ones travel together at first, by the hash of the bytes that all of them hold;
   where that is unique in the corpus they are. Of groups of equal bytes all but the
   first are covered as a whole, and only the first ones' windows meet each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, ranked, saved, text_of
from .tokenization import text_slices

LENGTH = 100
Q = 16
#: Occurrences of an anchor above which its contexts are salted.
HOT = 4096
BUCKET_CONTEXTS = 20_000
#: Salted contexts are spread by document and by stretches of so many bytes.
SALT_BYTES = 16_384
#: A place packs 40 bits of a document's key and 24 of a position; wrong extra marks do no harm.
#: Hot marks have bits of the anchor's hash with them, so that all occurrences of an anchor are hot or none.
PLACE_BITS = 24

MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchor_runs(datas: list[bytes], length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (hash, document, anchor, first and last window), places within the document."""
    sizes = np.array([len(d) for d in datas], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(datas), np.uint8)
    if len(flat) < length:
        empty = np.empty(0, np.int64)
        return (empty,) * 5
    h, width, power = flat.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while width < q:  # q is a power of two
        h = h[: len(h) - width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power & MASK
    h = mix(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - q + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(datas)), sizes)[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= ends[owner])
    if not len(at):
        empty = np.empty(0, np.int64)
        return (empty,) * 5
    anchor, owner = anchor[at], owner[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    doc, base = owner[first], (ends - sizes)[owner[first]]
    return h[anchor[first]].view(np.int64), doc, anchor[first] - base, at[first] - base, at[last] - base


def places_of(keys: np.ndarray, positions: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << PLACE_BITS) - 1)
    return ((keys.view(np.uint64) & ~low) | (positions.astype(np.uint64) & low)).view(np.int64)


def hot_tags(hashes: np.ndarray) -> np.ndarray:
    """38 bits of the hashes, never 0."""
    return (hashes.view(np.uint64) >> np.uint64(27) << np.uint64(1) | np.uint64(1)).view(np.int64)


def marked_and_hot(at: np.ndarray, hashes: np.ndarray, marks: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors have a mark at their place, and which a hot one with their own tag."""
    known, place = np.unique(marks, return_inverse=True)
    own = np.searchsorted(known, at)
    found = np.isin(at, known)
    return found, found & np.isin(own << 38 | hot_tags(hashes), place.reshape(-1) << 38 | tags)


def repeated_anchors(keyed: DataFrame, length: int, q: int, hot: int) -> DataFrame:
    """Rows (place, tag) of anchors that occur more than once, and maybe a few more at partition ends; the tag is 0 if not hot."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, texts = pdf["key"].to_numpy(np.int64), pdf["text"].tolist()
            for lo, hi in text_slices(texts):
                hashes, doc, anchor, _, _ = anchor_runs([t.encode() for t in texts[lo:hi]], length, q)
                yield pd.DataFrame({"hash": hashes, "place": places_of(keys[lo:hi][doc], anchor)})

    def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of a run that goes on in the next batch no more than ``hot`` places are held
        hashes = places = np.empty(0, np.int64)
        first = flowing = None
        for pdf in batches:
            hashes = np.concatenate([hashes, pdf["hash"].to_numpy(np.int64)])
            places = np.concatenate([places, pdf["place"].to_numpy(np.int64)])
            if not len(hashes):
                continue
            first = hashes[0] if first is None else first
            starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            counts = np.diff(np.append(starts, len(hashes)))
            many = np.repeat(counts, counts)
            # a run at an end of the range may go on in the next partition, where it is at an end too
            is_hot = (hashes == first) | (hashes == flowing) | (many > hot)
            flowing = hashes[-1] if is_hot[-1] else None
            stop = len(hashes) if is_hot[-1] else starts[-1]
            take = np.flatnonzero((is_hot | (many > 1))[:stop])
            yield pd.DataFrame({"place": places[take], "tag": np.where(is_hot[take], hot_tags(hashes[take]), 0)})
            hashes, places = hashes[stop:], places[stop:]
        if len(hashes):
            yield pd.DataFrame({"place": places, "tag": hot_tags(hashes)})

    anchors = keyed.select("key", "text").mapInPandas(emit, "hash long, place long")
    ranged = anchors.repartitionByRange("hash", "place").sortWithinPartitions("hash", "place")
    return ranged.mapInPandas(repeats, "place long, tag long")


def suffix_ranks(flat: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4 ... 64 bytes at every position, by doubling."""
    ranks = [flat.astype(np.int64)]
    width = 1
    while width < 64:
        r = ranks[-1]
        nxt = np.zeros_like(r)
        nxt[:-width] = r[width:] + 1
        pair = r * (int(r.max()) + 2) + nxt
        ranks.append(pair if width == 1 else np.unique(pair, return_inverse=True)[1].reshape(-1))
        width *= 2
    return ranks


def interval_scan(lcp: np.ndarray, order: np.ndarray, left: np.ndarray, boundary: np.ndarray):
    """Stack scan of one cluster of neighbouring suffixes.

    Yields (common length, first, others) of each interval whose left
    extensions differ or are unknown. ``first`` is the earliest entry; ``others``
    those that no inner interval covers already.
    """
    # open interval: [common length, entries not covered further in, left byte or -1 if they differ]
    stack: list[list] = []

    def close():
        length, entries, byte = stack.pop()
        first = min(entries, key=order.__getitem__)
        if byte < 0:
            yield length, first, [e for e in entries if e != first]
        return first, byte

    n = len(order)
    for i in range(n):
        common = int(lcp[i]) if i < n - 1 else 0  # with the next entry
        entry, byte = i, -1 if boundary[i] else int(left[i])
        if stack and stack[-1][0] >= common or not stack and common == 0:
            if stack:
                top = stack[-1]
                top[1].append(entry)
                if top[2] != byte:
                    top[2] = -1
            while stack and stack[-1][0] > common:
                entry, byte = yield from close()
                if common and not (stack and stack[-1][0] >= common):
                    stack.append([common, [entry], byte])
                elif stack:
                    top = stack[-1]
                    top[1].append(entry)
                    if top[2] != byte:
                        top[2] = -1
        else:
            stack.append([common, [entry], byte])


def repeats_in_bucket(order: np.ndarray, groups: np.ndarray, anchors: np.ndarray, bodies: list[bytes], lefts: np.ndarray, length: int):
    """Maximal repeat groups among contexts: yields (common length, first, others) as (context, offset) pairs.

    ``order`` ranks contexts by place, ``groups`` tells their anchor hash as a number,
    ``anchors`` the anchor's offset, ``lefts`` the byte before or -1.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    pad = 1
    begins = np.cumsum(sizes + pad) - sizes - pad
    flat = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    ranks = suffix_ranks(flat)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(bodies)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[owner] + offset
    # windows of equal bytes have equal anchors at equal offsets
    tail = min(64, length)
    top = ranks[-1]
    # `length` bytes are covered by two blocks of 64, or by one and smaller ones below 64
    blocks = [top[at], top[at + length - tail]] if length >= 64 else [ranks[int(np.log2(length))][at], ranks[int(np.log2(length))][at + length - (1 << int(np.log2(length)))]]
    if length > 128:
        blocks = [top[at + x] for x in range(0, length - 64, 64)] + [top[at + length - 64]]
    key = mix(groups[owner].astype(np.uint64) * np.uint64(MULTIPLIER) + (anchors[owner] - offset).astype(np.uint64))
    for b in blocks:
        key = mix(key * np.uint64(MULTIPLIER) + b.astype(np.uint64))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    keep = counts[inverse] > 1
    if not keep.any():
        return
    owner, offset, at, cluster = owner[keep], offset[keep], at[keep], inverse[keep]
    # a cluster with one byte to the left of all lies in the cluster one place before
    unknown = offset == 0
    left = np.where(offset == 0, lefts[owner], flat[np.maximum(at - 1, 0)])
    lo, hi = np.full(len(counts), 512), np.full(len(counts), -2)
    np.minimum.at(lo, cluster, left)
    np.maximum.at(hi, cluster, left)
    edge = np.zeros(len(counts), bool)
    edge[cluster[unknown]] = True
    live = (lo != hi)[cluster] | edge[cluster]
    owner, offset, at, cluster, left, unknown = (x[live] for x in (owner, offset, at, cluster, left, unknown))
    if not len(owner):
        return
    room = sizes[owner] - offset
    keys = [np.where(room > w, top[np.minimum(at + w, len(top) - 1)] + 1, 0) for w in range(int(room.max()) // 64 * 64, -1, -64)]
    by = np.lexsort((*keys, cluster))
    owner, offset, at, cluster, left, unknown, room = (x[by] for x in (owner, offset, at, cluster, left, unknown, room))
    # common prefixes of neighbours, by blocks of falling width
    lcp = np.zeros(len(at), np.int64)
    same = np.flatnonzero(cluster[1:] == cluster[:-1])
    a, b, common = at[same], at[same + 1], np.zeros(len(same), np.int64)
    most = np.minimum(room[same], room[same + 1])
    for level in [*[6] * (int(room.max()) // 64 + 1), *range(5, -1, -1)]:
        fits = common + (1 << level) <= most
        x, y = np.where(fits, a + common, 0), np.where(fits, b + common, 0)
        common += np.where(fits & (ranks[level][x] == ranks[level][y]), 1 << level, 0)
    lcp[same] = np.where(common >= length, common, 0)
    rank = order[owner].astype(np.int64) * (int(sizes.max()) + 1) + offset
    starts = np.flatnonzero(np.append(True, lcp[:-1] == 0))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        if e - s > 1:
            for common_length, first, others in interval_scan(lcp[s : e - 1], rank[s:e], left[s:e], unknown[s:e]):
                yield common_length, (owner[s + first], offset[s + first]), [(owner[s + o], offset[s + o]) for o in others]


def _covered(pdf: pd.DataFrame, length: int, hot_from: int) -> tuple[list[tuple], list[tuple]]:
    """Covered ranges of a bucket, and of a salted one the stretches of windows that are first in it."""
    pdf = pdf.sort_values(["id", "key", "lo"], na_position="first", kind="stable").reset_index(drop=True)
    own = list(zip(pdf["id"].tolist(), pdf["key"].tolist(), pdf["lo"].tolist(), strict=True))
    his = pdf["hi"].tolist()
    bodies = [c[skip:] for c, skip in zip(pdf["context"], (pdf["lo"] > 0).astype(int), strict=True)]
    firsts: dict[tuple, int] = {}
    ranges = []
    for i, body in enumerate(zip(pdf["hash"].tolist(), bodies, strict=True)):
        first = firsts.setdefault(body, i)
        if first != i and own[first] != own[i]:
            ranges.append((*own[i], his[i] + length))
    distinct = pdf.iloc[list(firsts.values())]
    salted = int(pdf["bucket"].iloc[0]) >= hot_from
    many = distinct[distinct.duplicated("hash", keep=False)]
    repeats: dict[int, list[tuple[int, int]]] = {}
    if len(many):
        rows = many.index.to_numpy()
        some = [bodies[i] for i in rows]
        lefts = np.array([c[0] if lo > 0 else -1 for c, lo in zip(many["context"], many["lo"], strict=True)], np.int64)
        groups = pd.factorize(many["hash"])[0]
        anchors = (many["anchor"] - many["lo"]).to_numpy(np.int64)
        for common, _, others in repeats_in_bucket(np.arange(len(rows)), groups, anchors, some, lefts, length):
            for c, offset in others:
                doc, key, lo = own[rows[c]]
                ranges.append((doc, key, lo + int(offset), lo + int(offset) + int(common)))
                if salted:
                    repeats.setdefault(int(rows[c]), []).append((int(offset), int(offset) + int(common)))
    rest = []
    if salted:  # windows that are first in this share meet those of other shares
        for i in distinct.index.tolist():
            free = np.ones(len(bodies[i]) - length + 1, bool)
            for start, stop in repeats.get(i, ()):
                free[start : stop - length + 1] = False
            edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                doc, key, lo = own[i]
                rest.append((doc, key, lo + start, int(pdf["anchor"].iloc[i]), bodies[i][start : stop - 1 + length]))
    return ranges, rest


def removed_ranges(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """Rows (id, key, ranges): the covered byte ranges of each keyed document (id, key, text) that has any; ids are not null or not numbers."""
    kind = docs.schema["id"].dataType
    marks = saved(repeated_anchors(docs, length, q, hot), "anchors")
    buckets = max(1, -(-marks.count() // BUCKET_CONTEXTS))
    low = (1 << PLACE_BITS) - 1
    by_doc = marks.groupBy(F.col("place").bitwiseAND(F.lit(~low)).alias("doc")).agg(
        F.collect_list(F.shiftleft("tag", PLACE_BITS) + F.col("place").bitwiseAND(F.lit(low))).alias("marks")
    )
    marked = docs.withColumn("doc", F.col("key").bitwiseAND(F.lit(~low))).join(by_doc, "doc")

    longs = ("hash", "key", "lo", "hi", "anchor")
    fields = [T.StructField("bucket", T.LongType()), T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in longs)]
    contexts_schema = T.StructType([*fields, T.StructField("context", T.BinaryType())])

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys, texts, own = pdf["id"], pdf["key"].to_numpy(np.int64), pdf["text"].tolist(), pdf["marks"].tolist()
            for a, b in text_slices(texts, 1_000_000):
                datas = [t.encode() for t in texts[a:b]]
                hashes, doc, anchor, lo, hi = anchor_runs(datas, length, q)
                marks = [np.asarray(m, np.int64) for m in own[a:b]]
                marked_at = np.concatenate([(m & low) + (i << PLACE_BITS) for i, m in enumerate(marks)])
                found, is_hot = marked_and_hot((doc << PLACE_BITS) + (anchor & low), hashes, marked_at, np.concatenate(marks) >> PLACE_BITS)
                take = np.flatnonzero(found)
                hashes, doc, anchor, lo, hi, is_hot = (x[take] for x in (hashes, doc, anchor, lo, hi, is_hot))
                salt = mix(keys[a:b][doc].view(np.uint64) + (anchor // SALT_BYTES).astype(np.uint64))
                spread = (mix(hashes.view(np.uint64) ^ np.where(is_hot, salt, np.uint64(0))) % np.uint64(buckets)).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "bucket": spread + np.where(is_hot, buckets, 0),
                        "id": ids.iloc[a:b].to_numpy()[doc],
                        "hash": hashes,
                        "key": keys[a:b][doc],
                        "lo": lo,
                        "hi": hi,
                        "anchor": anchor,
                        "context": [datas[d][max(x - 1, 0) : y + length] for d, x, y in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True)],
                    }
                )

    out_schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("key", "start", "stop", "anchor")), T.StructField("context", T.BinaryType())])

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        ranges, rest = _covered(pdf, length, buckets)
        found = pd.DataFrame(ranges, columns=["id", "key", "start", "stop"])
        found["context"] = found["anchor"] = None
        left = pd.DataFrame(rest, columns=["id", "key", "start", "anchor", "context"])
        left["stop"] = None
        return pd.concat([x.astype({"id": object, "stop": "Int64", "anchor": "Int64"})[out_schema.names] for x in (found, left)])

    ready = marked.select("id", "key", "text", "marks").mapInPandas(contexts, contexts_schema)
    found = saved(ready.groupBy("bucket").applyInPandas(cover, out_schema), "ranges")
    ranges = found.where("context is null").select("id", "key", "start", "stop")

    # what salted anchors have left, at first in groups of windows by their distance from the anchor, which equal windows share
    step = max(1, length // 14)
    part_schema = T.StructType([*out_schema.fields[:3], T.StructField("context", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("h1", "h2"))])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            rows, digests = [], []
            for doc, key, start, anchor, data in zip(pdf["id"].tolist(), pdf["key"].tolist(), pdf["start"].tolist(), pdf["anchor"].tolist(), pdf["context"].tolist(), strict=True):
                last = start + len(data) - length
                for group in range((anchor - last) // step, (anchor - start) // step + 1):
                    held = anchor - step * group - start  # all windows of the group hold the bytes from here on
                    lo, hi = max(0, held - step + 1), min(last - start, held)
                    rows.append((doc, key, start + lo, data[lo : hi + length]))
                    digests.append(xxhash.xxh3_128_digest(group.to_bytes(8, "little") + data[held : held - step + 1 + length]))
            out = pd.DataFrame(rows, columns=part_schema.names[:4])
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield out.assign(h1=halves[:, 0], h2=halves[:, 1])

    hot_parts = saved(found.where("context is not null").select("id", "key", "start", "anchor", "context").mapInPandas(parts, part_schema), "hot-parts")
    again = hot_parts.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    place = F.struct("id", "key", "start")
    open_parts = saved(hot_parts.join(again, ["h1", "h2"]).select("id", "key", "start", "context"), "open-parts")
    first_parts = saved(open_parts.groupBy("context").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first-parts")
    copies = open_parts.join(first_parts.where("n > 1"), "context").where(place > F.col("first"))
    copies = copies.select("id", "key", "start", (F.col("start") + F.octet_length("context")).alias("stop"))

    # then each window by itself
    window_schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("key", "start", "h1", "h2"))])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                n = [len(c) - length + 1 for c in part["context"]]
                digests = b"".join(xxhash.xxh3_128_digest(c[i : i + length]) for c, k in zip(part["context"], n, strict=True) for i in range(k))
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                which = np.repeat(np.arange(len(part)), n)
                start = part["start"].to_numpy(np.int64)[which] + np.concatenate([np.arange(k) for k in n])
                yield pd.DataFrame({"id": part["id"].to_numpy()[which], "key": part["key"].to_numpy()[which], "start": start, "h1": halves[:, 0], "h2": halves[:, 1]})

    hot_windows = first_parts.select("first.id", "first.key", "first.start", "context").mapInPandas(windows, window_schema)
    earliest = hot_windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    more = hot_windows.join(earliest, ["h1", "h2"]).where(place > F.col("first")).select("id", "key", "start", (F.col("start") + length).alias("stop"))
    # of a document at most its own ranges meet here
    return ranges.unionByName(copies).unionByName(more).groupBy("id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def merged(ranges) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, hot: int = HOT, carry: bool = False) -> DataFrame:
    """Rows (id, n_bytes, removed(array of start, stop), kept(binary), kept_text), one per document.

    ``kept_text`` is without characters that a cut has split.

    Places are ordered by id, then start; null ids come first, tied ids by key. Null text is
    empty. Rows that repeat id and text are one document and cut alike; a
    repeated id with another text is another document. Texts shorter than
    ``length`` stay whole. Other columns are ignored, or with ``carry`` come along
    as struct ``row``; an empty table gives no rows. ``length`` is at least 2 * ``q``.
    """
    text = text_of(text_col)
    rank = ranked(id_col, docs.schema[id_col].dataType)
    keyed = [F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text")]
    ranges = saved(removed_ranges(docs.select(rank.alias("id"), *keyed), length, q, hot), "removed")
    columns = [F.col(id_col).alias("id"), rank.alias("rank"), *keyed]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    other = ranges.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "ranges")
    both = docs.select(*columns).join(other, F.expr("key = key_ and rank <=> id_"), "left")
    span = "array<struct<start: long, stop: long>>"

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            rows = []
            for text, found in zip(texts, ranges, strict=True):
                if text is None:  # nothing to cut: the text stays in the JVM
                    rows.append((None, None, None))
                    continue
                data = text.encode()
                runs = merged((r["start"], r["stop"]) for r in found)
                edges = [0, *[x for run in runs for x in run], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append(([{"start": a, "stop": b} for a, b in runs], kept, kept.decode("utf-8", "ignore")))
            yield pd.DataFrame(rows, columns=["removed", "kept", "kept_text"])

    cut_udf = F.pandas_udf(cut, f"removed {span}, kept binary, kept_text string")
    touched = both.withColumn("cut", cut_udf(F.when(F.col("ranges").isNotNull(), F.col("text")), "ranges"))
    done = touched.withColumns(
        {
            "removed": F.coalesce("cut.removed", F.array().cast(span)),
            "kept_text": F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.col("cut.kept_text")),
            "kept": F.when(F.col("ranges").isNull(), F.col("text").cast("binary")).otherwise(F.col("cut.kept")),
        }
    )
    return done.select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), "removed", "kept", "kept_text", *(["row"] if carry else []))
