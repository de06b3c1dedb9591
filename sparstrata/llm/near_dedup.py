"""Near-duplicate detection by DartMinHash signatures and banded joins.

Elements are shingles of five words. Over the region (weight of an element) x
(rank) darts fall as a Poisson process of unit rate, drawn from a hash of the
element alone, so equal elements get equal darts in any document. A document
looks at darts of rank up to about t / (its total weight), t = k (ln k + 2): the
number of darts is the same for short and long texts. Each dart belongs to one of
k coordinates; the earliest of a coordinate is its sample, and two documents
agree there with the probability of their weighted Jaccard similarity.

Texts with equal word sequences are one node, so copies never meet as pairs.
Nodes that share a band are candidates. Two exact bounds keep their pairs few
before any set travels. A shingle that no other candidate has is in no overlap, so
nodes without enough common shingles leave; texts that share a long passage and
nothing else go here, however many they are. And the overlap of two nodes is at
most the sum, over groups of shingles, of the lesser of their numbers of common
shingles in the group. All other candidate links are decided by the exact
similarity, but links inside a component found already are not needed: first
every node is tested against the pivot of its buckets with the largest share of
common shingles, the centre of a group of copies, components grow, and then
buckets test only pairs between components, wide ones by some pivots at first and
by several times as many each turn until no pair is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, components, forget, restored, saved, small, text_of
from .tokenization import text_slices

SHINGLE = 5
THRESHOLD = 0.8
#: A link of similarity 0.8 shares no band with a probability of 1.3e-7.
BANDS = 40
ROWS = 5
#: Groups of shingles whose numbers bound an overlap.
GROUPS = 64
#: Candidates are broadcast up to so many rows (24 bytes each), beyond that joined by shuffle.
BROADCAST_ROWS = 500_000
#: A bucket tests all its pairs between components at once if they are no more than this for each member, else by so many pivots.
CROSS_PAIRS = 256
#: Both grow by this factor each turn: a bucket without links ends after a logarithm of turns, one with links shrinks between them.
TURN_GROWTH = 4

MASK = (1 << 64) - 1
WORD = re.compile(r"\w+")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each character, whether it is part of a word, and its random number."""
    part = np.fromiter((WORD.match(chr(c)) is not None for c in range(0x110000)), bool, 0x110000)
    return part, mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text in lower case: polynomials over the random numbers of their characters."""
    part, numbers = _characters()
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = part[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    lengths = stops - starts
    ends = np.cumsum([len(t) + 1 for t in lower])
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    powers = np.full(int(lengths.max()), 0xD1342543DE82EF95, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    firsts = np.cumsum(lengths) - lengths
    terms = numbers[codes[inside]] * powers[np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)]
    hashes = mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))
    return np.split(hashes, np.searchsorted(starts, ends[:-1]))


def shingle_hashes(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return out


def dart_signatures(sizes: np.ndarray, elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """Samples (uint64, one row of k per set) of weighted sets of distinct elements, laid end to end.

    Weights None are all 1. Weights are laid out in strips of height 1. Arrival
    ranks of a strip's darts are running sums of exponential gaps; a dart counts
    if its height in the strip is within the element's weight. Sets are not empty.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if weights is None:
        total, strips, height = sizes.astype(np.float64), mix(elements), None
    else:
        total = np.bincount(owner, weights, len(sizes))
        layers = np.ceil(weights).astype(np.int64)
        element = np.repeat(np.arange(len(elements)), layers)
        layer = np.arange(len(element)) - np.repeat(np.cumsum(layers) - layers, layers)
        strips = mix(elements[element] + np.uint64(0x632BE59BD9B4E019) * layer.astype(np.uint64))
        owner, height = owner[element], np.minimum(weights[element] - layer, 1.0)
    limit = k * (np.log(k) + 2) / total
    unit = 2.0**-53
    out = np.zeros((len(sizes), k), np.uint64)
    todo = np.arange(len(strips))
    while len(todo):
        ranks, seeds, owners = [], [], []
        live, rank, step = todo, np.zeros(len(todo)), 0
        while len(live):
            step += 1
            seed = mix(strips[live] + np.uint64(step * 0x9E3779B97F4A7C15 & MASK))
            rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * unit)
            near = rank <= limit[owner[live]]
            live, rank, seed = live[near], rank[near], seed[near]
            inside = slice(None)
            if height is not None:
                inside = (mix(seed ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)).astype(np.float64) * unit < height[live]
            ranks.append(rank[inside])
            seeds.append(seed[inside])
            owners.append(owner[live][inside])
        ranks, seeds, owners = np.concatenate(ranks), mix(np.concatenate(seeds)), np.concatenate(owners)
        slot = owners * k + (seeds % np.uint64(k)).astype(np.int64)
        earliest = np.full(out.size, np.inf)
        np.minimum.at(earliest, slot, ranks)
        first = ranks == earliest[slot]
        out.reshape(-1)[slot[first]] = seeds[first]
        # sets with a coordinate that no dart hit look further, which keeps their earlier darts
        short = np.isinf(earliest.reshape(-1, k)).any(axis=1)
        limit = np.where(short, 2 * limit, limit)
        todo = todo[short[owner[todo]]]
    return out


def band_hashes(samples: np.ndarray, bands: int) -> np.ndarray:
    parts = samples.reshape(len(samples), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for i in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """Rows (id, key, node, size, bands) of ``docs(id, key, text)``: node a digest of the word sequence, size the weight of its shingles."""
    kind = docs.schema["id"].dataType
    schema = "id string, key long, node binary, size long, bands array<long>"
    k = bands * rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            ids, keys, texts = pdf["id"], pdf["key"], pdf["text"].tolist()
            for lo, hi in text_slices(texts, 1_000_000):
                nodes, sets, counts = [], [], []
                for words in word_hashes(texts[lo:hi]):
                    nodes.append(xxhash.xxh3_128_digest(words.tobytes()))
                    elements, times = np.unique(shingle_hashes(words, width), return_counts=True)
                    sets.append(elements)
                    counts.append(times)
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                found = [np.empty(0, np.int64)] * len(sets)
                if len(full):
                    weights = np.concatenate(counts).astype(np.float64) if weighted else None
                    for i, own in zip(full, band_hashes(dart_signatures(sizes[full], np.concatenate(sets), weights, k), bands), strict=True):
                        found[i] = own
                totals = [int(c.sum()) for c in counts] if weighted else sizes
                yield pd.DataFrame({"id": ids.iloc[lo:hi].to_numpy(), "key": keys.iloc[lo:hi].to_numpy(), "node": nodes, "size": totals, "bands": found})

    signed = docs.select(carried("id").alias("id"), "key", "text").mapInPandas(run, schema)
    return signed.withColumn("id", restored("id", kind))


def shingle_sets(docs: DataFrame, width: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """Rows (uid, size, shingles, counts) of ``docs(uid, node, text)``; rows whose text is not the node's are left out. Counts are 1 if not weighted."""
    schema = "uid long, size long, shingles array<long>, counts array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            uids, nodes, texts = pdf["uid"].tolist(), pdf["node"].tolist(), pdf["text"].tolist()
            for lo, hi in text_slices(texts):
                rows = []
                for uid, node, words in zip(uids[lo:hi], nodes[lo:hi], word_hashes(texts[lo:hi]), strict=True):
                    if xxhash.xxh3_128_digest(words.tobytes()) == node:
                        shingles, times = np.unique(shingle_hashes(words, width).view(np.int64), return_counts=True)
                        times = times if weighted else np.ones_like(times)
                        rows.append((uid, int(times.sum()), shingles, times))
                yield pd.DataFrame(rows, columns=["uid", "size", "shingles", "counts"])

    return docs.mapInPandas(run, schema)


def common_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Written rows (uid, size, mass, sketch, shingles, counts): of each set the shingles that others have, too.

    ``mass`` is their weight, ``sketch`` its division over groups of shingles.
    Sets whose mass shows that nothing is similar to them are left out.
    """
    # a shingle that is everywhere leaves a task as one row; of the rest of a set at most all its shingles meet
    lone = sets.select("uid", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    lone = lone.where("n = 1").groupBy("uid").agg(F.collect_list("shingle").alias("lone"))
    schema = "uid long, size long, mass long, sketch array<int>, shingles array<long>, counts array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uid, size, shingles, counts, gone in zip(pdf["uid"].tolist(), pdf["size"].tolist(), pdf["shingles"], pdf["counts"], pdf["lone"], strict=True):
                if gone is not None:
                    shared = ~np.isin(shingles, gone, assume_unique=True)
                    shingles, counts = shingles[shared], counts[shared]
                mass = int(counts.sum())
                if mass >= threshold * size - 1e-9:
                    sketch = np.bincount(shingles & (GROUPS - 1), counts, GROUPS).astype(np.int32)
                    rows.append((uid, size, mass, sketch, shingles, counts))
            yield pd.DataFrame(rows, columns=["uid", "size", "mass", "sketch", "shingles", "counts"])

    return saved(sets.join(lone, "uid", "left").mapInPandas(run, schema), "shingles")


def comparable(threshold: float):
    """Condition on the columns of two nodes, those of the second with ``other_`` before: their bounds allow a similarity of ``threshold``."""
    needed = threshold * (F.col("size") + F.col("other_size")) - 1e-9
    by_mass = F.least("mass", "other_mass") * (1 + threshold) >= needed
    lesser = F.zip_with("sketch", "other_sketch", lambda x, y: F.least(x, y))
    by_group = F.aggregate(lesser, F.lit(0), lambda total, x: total + x) * (1 + threshold) >= needed
    return by_mass & by_group


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs(a, b)`` those with a similarity of ``threshold`` or more, by their common shingles and whole sizes."""
    side = lambda x: sets.select(F.col("uid").alias(x), F.col("size").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"), F.col("counts").alias(f"c{x}"))
    # a pair travels with one set and then meets the other; AQE splits a pivot that many pairs share
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for na, sa, ca, nb, sb, cb in zip(pdf["na"], pdf["sa"], pdf["ca"], pdf["nb"], pdf["sb"], pdf["cb"], strict=True):
                _, i, j = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                shared = np.minimum(ca[i], cb[j]).sum()
                good.append(shared >= threshold * (na + nb - shared) - 1e-9)
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _relabelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("root", F.col("uid"))
    own = labels.withColumnRenamed("node", "uid")
    return members.drop("root").join(own, "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def linked(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """Rows (node, root) of all nodes of components of more than one node, or None.

    ``members(bucket, uid, size, mass, sketch)`` are the nodes of each bucket, ``sets`` their common shingles.
    """
    facts = ["uid", "size", "mass", "sketch"]
    other = [F.col(c).alias(f"other_{c}") for c in (*facts, "root")]
    fits = comparable(threshold)
    labels, reach, first_turn, past = None, CROSS_PAIRS, True, None
    while True:
        members = _relabelled(members, labels)
        shares = members.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        cross = F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))  # twice the pairs between components
        open_buckets = shares.groupBy("bucket").agg((cross <= 2 * reach * F.sum("c")).alias("small"), cross.alias("cross")).where("cross > 0").drop("cross")
        members = saved(members.join(open_buckets, "bucket"), "members")
        forget(past)
        past = members
        if members.isEmpty():
            return labels
        if first_turn:
            # one test for each node at first: most join their component, and their other pairs are never made
            share = F.col("mass") / F.col("size")
            pivots = members.groupBy("bucket").agg(F.max(F.struct(share.alias("share"), (-F.col("uid")).alias("first"), *facts)).alias("best"))
            pivots = pivots.select("bucket", "best.share", "best.first", *[F.col(f"best.{c}").alias(f"other_{c}") for c in facts])
            near = members.join(pivots, "bucket").where(F.col("uid") != F.col("other_uid")).where(fits)
            near = near.groupBy("uid").agg((-F.max(F.struct("share", "first"))["first"]).alias("pivot"))
            pairs = near.select(F.least("uid", "pivot").alias("a"), F.greatest("uid", "pivot").alias("b")).distinct()
        else:
            chosen = members.where("not small").groupBy("bucket", F.pmod(F.xxhash64("uid"), F.lit(reach))).agg(F.min("uid").alias("uid")).select("bucket", "uid")
            wide = members.join(chosen, ["bucket", "uid"], "left_semi")
            either = members.where("small").unionByName(wide).select("bucket", *other)
            met = members.join(either, "bucket").where("root < other_root or root > other_root and not small").where(fits)
            pairs = met.select(F.least("uid", "other_uid").alias("a"), F.greatest("uid", "other_uid").alias("b")).distinct()
        links = saved(similar(pairs, sets, threshold), "links")
        joined = members.select("uid", "root").distinct()
        a = joined.select(F.col("uid").alias("a"), F.col("root").alias("root_a"))
        b = joined.select(F.col("uid").alias("b"), F.col("root").alias("root_b"))
        found = components(links.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        forget(links)
        if labels is None:
            labels = found
        else:
            up = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            before, labels = labels, saved(moved.unionByName(found.join(labels, "node", "left_anti")), "labels")
            forget(before)
        if not first_turn:
            # small buckets are done; of wide ones the pivots are
            members = members.where("not small").join(chosen, ["bucket", "uid"], "left_anti")
            reach *= TURN_GROWTH
        members = members.drop("small")
        first_turn = False


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """Rows (id, key, class_id, class_size, kept), one per document; key is xxhash64(id, text).

    A class is a connected component of documents linked by a similarity of
    ``threshold`` or more on shingles of ``width`` words (lower case, word
    characters); class_id is its smallest id, which is the one kept. With
    ``weighted`` shingles count as often as they occur. A text shorter than a
    shingle is one shingle; texts without words, null among them, form one
    class. Null ids come first. Of rows that repeat the kept id one with the
    smallest word digest is kept; rows that repeat id and text are one
    document, kept or dropped alike. Other columns are ignored; an empty table
    gives no rows.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    signed = saved(signatures(base, bands, rows, width, weighted), "signatures")
    nodes = signed.groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("uid"), "*"), "nodes")
    entries = nodes.select("uid", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = saved(entries.join(shared, "bucket"), "buckets")

    # whole texts of one document of each node in a bucket; a key may be that of another text, or its row repeat
    wanted = saved(buckets.select("uid").distinct().join(nodes.drop("bands"), "uid"), "wanted")
    texts = base.select("key", "text").join(small(wanted, BROADCAST_ROWS), "key").select("uid", "node", "text")
    raw = saved(shingle_sets(texts, width, weighted).dropDuplicates(["uid"]), "sets")
    sets = common_sets(raw, threshold)
    forget(raw, wanted)
    members = saved(buckets.join(sets.select("uid", "size", "mass", "sketch"), "uid"), "members")
    forget(buckets)
    labels = linked(members, sets, threshold)
    forget(members, sets)

    rooted = signed.select("id", "key", "node").join(nodes.select("node", "uid"), "node")
    if labels is None:
        rooted = rooted.withColumn("root", F.col("uid"))
    else:
        rooted = rooted.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    classes = rooted.groupBy("root").agg(F.min(F.struct("id", "node")).alias("best"), F.count("*").alias("class_size"))
    alone = F.col("best").isNull()
    return rooted.join(classes.where("class_size > 1"), "root", "left").select(
        F.col("id").alias(id_col),
        "key",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | (F.struct("id", "node") == F.col("best"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, with all their columns.

    Nulls, ties and repeated rows are treated as by ``near_groups``: rows that
    repeat id and text stay or go alike. An empty table gives no rows.
    """
    lost = near_groups(docs, id_col, text_col, threshold).where(~F.col("kept")).select(F.col(id_col).alias("lost_id"), F.col("key").alias("lost_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("key"))
    return rows.join(lost, F.expr("key = lost_key and own_id <=> lost_id"), "left_anti").select("row.*")
