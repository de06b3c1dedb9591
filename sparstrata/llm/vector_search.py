"""Approximate nearest neighbours: a hierarchical navigable graph per shard, results merged.

Vectors are dealt to shards of bounded size by their magnitude and a hash of their
row; vectors of very different magnitudes are in different shards, each scaled to
its own, so that single precision holds them. A shard's graph
has layers of geometrically falling size; each is a flat array of neighbours, a
row per node. Neighbours are chosen among the closest by the diversity rule
(one that is closer to a chosen neighbour than to the node is passed over) and
linked back. Every row is indexed. Queries meet every shard in blocks: they
descend through the layers and search the lowest with a beam, all queries of a
block at once.

Largest inner products are found by adding a component that gives all vectors of a
shard the same norm; queries get 0 there, so products do not change. The
candidates for a node's neighbours are the exact nearest in its shard, which is
small enough that one matrix product finds them sooner than searching would.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

SHARD_ROWS = 16_384
LEAST_SHARDS = 8
QUERY_BLOCK = 32_768
#: Shards hold vectors whose largest components are within this power of two.
MAGNITUDE_BITS = 8
#: Kinds of vectors (dimension and magnitude) are broadcast up to so many rows (24 bytes each), beyond that joined by shuffle.
BROADCAST_ROWS = 500_000
DEGREE = 16
CANDIDATES = 64
BEAM = 96


def node_levels(uids: np.ndarray, degree: int) -> np.ndarray:
    """Layer of each node, from a hash of its row number; the share of each higher layer is 1 / degree."""
    x = uids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return (-np.log(u) / math.log(degree)).astype(np.int64)


def same_norm(vectors: np.ndarray) -> np.ndarray:
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    return np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)


def layer_graph(vectors: np.ndarray, members: np.ndarray, degree: int, candidates: int) -> np.ndarray:
    """Flat neighbour array of one layer: a row of 2 * degree node numbers per member, -1 where empty."""
    n, width = len(members), 2 * degree
    own = vectors[members]
    chosen = np.full((n, degree), -1, np.int64)
    most = min(candidates, n - 1)
    for lo in range(0, n, 512) if most else ():
        block = own[lo : lo + 512]
        sims = block @ own.T
        sims[np.arange(len(block)), np.arange(lo, lo + len(block))] = -np.inf
        near = np.argpartition(-sims, most - 1, 1)[:, :most]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), 1, kind="stable"), 1)
        to_node = np.take_along_axis(sims, near, 1)
        between = np.einsum("ijd,ikd->ijk", own[near], own[near])
        taken = np.zeros((len(block), most), bool)
        for j in range(most):
            closer = (between[:, j, :] > to_node[:, j : j + 1]) & taken
            taken[:, j] = ~closer.any(1) & (taken.sum(1) < degree)
        # room that is left goes to the closest passed over
        order = np.argsort(~taken, 1, kind="stable")[:, :degree]
        chosen[lo : lo + 512, : order.shape[1]] = np.take_along_axis(near, order, 1)
    # links back, the closest first, as far as there is room
    source, target = np.repeat(np.arange(n), degree), chosen.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    ends = np.concatenate([np.column_stack([source, target, np.zeros(len(source), np.int64)]), np.column_stack([target, source, np.ones(len(source), np.int64)])])
    sims = np.einsum("ij,ij->i", own[ends[:, 0]], own[ends[:, 1]])
    ends = ends[np.lexsort((-sims, ends[:, 2], ends[:, 0]))]
    ends = ends[np.sort(np.unique(ends[:, 0] * n + ends[:, 1], return_index=True)[1])]
    starts = np.searchsorted(ends[:, 0], np.arange(n))
    slot = np.arange(len(ends)) - starts[ends[:, 0]]
    ends, slot = ends[slot < width], slot[slot < width]
    out = np.full((n, width), -1, np.int32)
    out[ends[:, 0], slot] = members[ends[:, 1]]
    return out


def build(vectors: np.ndarray, uids: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Vectors of one norm and, from the lowest layer up, (members, flat neighbour array)."""
    even = same_norm(vectors)
    levels = node_levels(uids, degree)
    layers = []
    for level in range(int(levels.max()) + 1):
        members = np.flatnonzero(levels >= level)
        layers.append((members, layer_graph(even, members, degree, candidates)))
    return even, layers


def beam_search(queries: np.ndarray, vectors: np.ndarray, members: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int) -> np.ndarray:
    """Nodes of the beam of each query at its end, closest first, -1 where empty."""
    q, n = len(queries), len(vectors)
    row_of = np.full(n, -1, np.int64)
    row_of[members] = np.arange(len(members))
    nodes = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    spent = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    w = min(beam, entries.shape[1])
    nodes[:, :w] = entries[:, :w]
    full = nodes >= 0
    sims[full] = np.einsum("ij,ij->i", queries[np.nonzero(full)[0]], vectors[nodes[full]])
    seen[np.nonzero(full)[0], nodes[full]] = True
    live = np.arange(q)
    while len(live):
        open_sims = np.where(spent[live] | (nodes[live] < 0), -np.inf, sims[live])
        best = open_sims.argmax(1)
        go = open_sims[np.arange(len(live)), best] > -np.inf
        live, best = live[go], best[go]
        if not len(live):
            break
        spent[live, best] = True
        near = links[row_of[nodes[live, best]]].astype(np.int64)
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        i, j = np.nonzero(new)
        seen[live[i], near[i, j]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[i, j] = np.einsum("ij,ij->i", queries[live[i]], vectors[near[i, j]])
        all_sims = np.concatenate([sims[live], got], 1)
        all_nodes = np.concatenate([nodes[live], np.where(new, near, -1)], 1)
        all_spent = np.concatenate([spent[live], np.zeros(near.shape, bool)], 1)
        keep = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        sims[live], nodes[live], spent[live] = (np.take_along_axis(x, keep, 1) for x in (all_sims, all_nodes, all_spent))
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(nodes, order, 1)


def search(queries: np.ndarray, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int = BEAM) -> np.ndarray:
    """Descend through the layers, then search the lowest with the whole beam."""
    padded = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
    top = layers[-1][0][:8]
    found = []
    for lo in range(0, len(padded), 512):
        block = padded[lo : lo + 512]
        entries = np.broadcast_to(top, (len(block), len(top)))
        for members, links in reversed(layers[1:]):
            entries = beam_search(block, vectors, members, links, entries, 16)[:, :8]
        found.append(beam_search(block, vectors, *layers[0], entries, beam))
    return np.concatenate(found)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two of its own, so that its largest component is between 1/2 and 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def participants(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Written rows (uid, id, vector, dim, magnitude) of those that take part: finite, not zero, with an id."""
    doubles = F.col(vector_col).cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # usual vectors, with components about 1, are in the midst of one magnitude
    largest = F.array_max(F.transform(doubles, lambda x: F.abs(x)))
    magnitude = F.floor((F.log2(largest) + MAGNITUDE_BITS / 2) / MAGNITUDE_BITS).cast("int")
    rows = table.where(F.col(id_col).isNotNull() & fine & F.exists(doubles, lambda x: x != 0))
    return saved(rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), doubles.alias("vector"), F.size(vector_col).alias("dim"), magnitude.alias("magnitude")), "vectors")


def build_index(rows: DataFrame, degree: int = DEGREE, candidates: int = CANDIDATES) -> DataFrame:
    """Written index: a row per shard of flat binary arrays; ``rows`` have their shard."""
    schema = "dim int, magnitude int, shard int, ids binary, uids binary, vectors binary, sizes array<int>, members array<binary>, links array<binary>"

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        vectors = np.stack(pdf["vector"].to_list())
        uids = pdf["uid"].to_numpy(np.int64)
        _, layers = build(np.ldexp(vectors, -MAGNITUDE_BITS * key[1]), uids, degree, candidates)
        return pd.DataFrame(
            {
                "dim": [key[0]],
                "magnitude": [key[1]],
                "shard": [key[2]],
                "ids": [pdf["id"].to_numpy("<i8").tobytes()],
                "uids": [uids.astype("<i8").tobytes()],
                "vectors": [vectors.astype("<f8").tobytes()],
                "sizes": [[len(m) for m, _ in layers]],
                "members": [[m.astype("<i4").tobytes() for m, _ in layers]],
                "links": [[x.astype("<i4").tobytes() for _, x in layers]],
            }
        )

    return saved(rows.groupBy("dim", "magnitude", "shard").applyInPandas(make, schema), "index")


def nearest(table: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """Rows (query_id, rank, id, score): for rows whose id is divisible by ``every``, the ``k`` nearest found.

    Nearness is the largest inner product in double precision, ties go to the
    smaller id. Vectors that are null, zero or hold null or non-finite
    components, and rows without id, take no part; vectors of another length are
    no candidates. Products beyond double precision are infinite, of different signs
    in one sum not a number. A row that repeats an id is another candidate; only the
    query's own row is left out. Fewer than k candidates are all returned. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = participants(table, id_col, vector_col)
    kinds = rows.groupBy("dim", "magnitude").agg(F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.count("*") / SHARD_ROWS)).cast("int").alias("shards"))
    kinds = small(saved(kinds, "kinds"), BROADCAST_ROWS)
    sharded = rows.join(kinds, ["dim", "magnitude"]).withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("shards")).cast("int"))
    index = build_index(sharded.drop("shards"), degree)
    queries = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int"))
    # every block of queries meets every shard of its dimension: a stated query set against all rows
    asked = queries.drop("magnitude").join(kinds, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    ready = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "query_id long, query_uid long, id long, uid long, score double"
    columns = ["query_id", "query_uid", "id", "uid", "score"]

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        own = right.iloc[0]
        ids, uids = np.frombuffer(own["ids"], "<i8"), np.frombuffer(own["uids"], "<i8")
        vectors = np.frombuffer(own["vectors"], "<f8").reshape(len(ids), -1)
        layers = [(np.frombuffer(m, "<i4").astype(np.int64), np.frombuffer(x, "<i4").reshape(size, -1)) for size, m, x in zip(own["sizes"], own["members"], own["links"], strict=True)]
        questions = np.stack(left["vector"].to_list())
        even = same_norm(np.ldexp(vectors, -MAGNITUDE_BITS * int(own["magnitude"])))
        found = search(scaled(questions), even, layers, max(beam, k + 1))
        q, j = np.nonzero(found >= 0)
        node = found[q, j]
        out = pd.DataFrame({"query_id": left["id"].to_numpy()[q], "query_uid": left["uid"].to_numpy()[q], "id": ids[node], "uid": uids[node]})
        out["score"] = np.einsum("ij,ij->i", questions[q], vectors[node])
        out = out[out["query_uid"] != out["uid"]].sort_values(["query_uid", "score", "id", "uid"], ascending=[True, False, True, True], kind="stable")
        return out[out.groupby("query_uid").cumcount() < k][columns]

    found = asked.groupBy("dim", "magnitude", "shard", "block").cogroup(ready.groupBy("dim", "magnitude", "shard", "block")).applyInPandas(ask, schema)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
