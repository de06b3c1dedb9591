"""Bit-plane clusters, line dedup and collocations against brute force, on small and awkward tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparstrata.llm import bitplane_clusters, bloom, collocations, common, line_dedup

MARKS = re.compile(r"[.,;:!?\x0A-\x0D]")


def test_planes_give_exact_products():
    rng = np.random.default_rng(3)
    for most in (1, 2, 70, 1 << 20, (1 << 27) - 1):
        x, c = (rng.integers(-most, most + 1, (n, 64)) for n in (50, 7))
        px, pc = bitplane_clusters.planes_of(x), bitplane_clusters.planes_of(c)
        assert (bitplane_clusters.values_of(px) == x).all()
        assert (bitplane_clusters.dots(px, pc) == x @ c.T).all()
        assert (bitplane_clusters.norms(px) == (x * x).sum(1)).all()


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "z", 0))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in found), key=str)


def test_clusters_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(64)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [None] * 64), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [0.0] * 64), (207, [0.0] * 64), (208, [1000.5] * 64), (209, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    table = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string, planes int")
    found = bitplane_clusters.clusters(table.repartition(5), k=6)
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows, 6, 3)
    few = bitplane_clusters.clusters(table.where("vec_id in (206, 207, 5)")).collect()
    assert len(few) == 3 and len({r.cluster for r in few}) == 2 and {r.inertia for r in few} == {0}
    assert bitplane_clusters.clusters(table.where("1 = 0")).count() == 0
    assert bitplane_clusters.clusters(table.where("vec_id = 200")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        bitplane_clusters.clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_bloom_parts_miss_nothing(spark):
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    twice = hashes[:700]
    bits = bloom.filter_bits(5000)
    batches = [bloom.part(x, bits) for x in (hashes[:2500], np.concatenate([hashes[2500:], twice[:400]]), twice[400:])]
    table = spark.createDataFrame([r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], bloom.SCHEMA)
    shards = bloom.merged(table)
    seen, often = (bloom.collected(spark, shards, c, bits).value for c in ("once", "twice"))
    assert bloom.holds(seen, hashes).all() and bloom.holds(often, twice).all()
    assert bloom.holds(often, hashes[700:]).mean() < 0.01 and bloom.holds(seen, hashes ^ np.uint64(0x5555)).mean() < 0.05


def brute_lines(rows, least, keep_first):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for _, t in rows]
    docs = {}
    for own in keys:
        for k in set(own) - {""}:
            docs[k] = docs.get(k, 0) + 1
    often, seen, out = {k for k, n in docs.items() if n >= least}, set(), []
    for n, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        lines, kept = (t or "").split("\n"), []
        for line, k in zip(lines, keys[n], strict=True):
            if k not in often or keep_first and k not in seen:
                kept.append(line)
            seen.add(k)
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [line_dedup.HOT_SHARE, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_against_brute_force(spark, monkeypatch, share, keep_first):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rng = random.Random(6)
    common = ["All rights reserved", " all RIGHTS reserved\t", "É seul", "é seul", "\x0bx\x0c", "", " ", "日本", " all rights reserved"]
    texts = ["\n".join(rng.choice([*common, f"own {rng.randrange(60)}"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "a\r\nA\r\n a", "long line " * 30_000, "\n".join(f"row {k % 7000}" for k in range(20_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, None)]
    table = spark.createDataFrame([(i, t, "k", 1, "l") for i, t in rows], "doc_id long, text string, key string, uid int, lines string").coalesce(1)
    found = line_dedup.drop_lines(table, 3, keep_first=keep_first)
    assert sorted(map(tuple, found.collect()), key=str) == brute_lines(rows, 3, keep_first)
    short = line_dedup.drop_lines(table, 3, keep_first=keep_first, with_text=False)
    assert sorted(map(tuple, short.collect()), key=str) == sorted((r[:4] for r in brute_lines(rows, 3, keep_first)), key=str)
    assert line_dedup.drop_lines(table.where("1 = 0"), 3).count() == 0


def test_lines_with_a_full_filter(spark, monkeypatch):
    """A filter that is far too small suspects all lines; the result is the same."""
    monkeypatch.setattr(bloom, "holds", lambda filled, hashes: np.ones(len(hashes), bool))
    rows = [(i, f"line {i % 5}\nown {i}\nline {i % 3}") for i in range(30)]
    found = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert sorted(map(tuple, found.collect()), key=str) == brute_lines(rows, 10, False)


def brute_phrases(rows, least, most):
    f, n = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        for piece in MARKS.split((text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] = n.get(lang, 0) + len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] = f.get((lang, tuple(w[i : i + size])), 0) + 1
    out = []
    for lang in n:
        own = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        scored = []
        for p, a in own.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(inside(q) and 100 * b >= 80 * a for q, b in own.items()):
                continue
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, small):
    if small:  # containers burst, subtrees are spilled, texts are cut in steps, no count is broadcast
        for name, value in {"BURST": 3, "ENTRIES": 40, "WORDS": 30, "HELD": 50, "STEP": 200, "RUN_ROWS": 7, "HOT_SHARE": 1, "SALTS": 3}.items():
            monkeypatch.setattr(collocations, name, value)
    rng = random.Random(8)
    words = ["The", "of", "né", "Éa", "cat", "日本", "x y", "New", "york", "a-b"]
    line = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]) for _ in range(k))
    rows = [(rng.choice(["en", "en", "de", None]), line(rng.randrange(60)) + rng.choice(["", "new york city is far"])) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("fr", " . "), ("zz", "alone"), ("en", "the cat " * 30_000), ("de", "tail " * 40_000 + ".")]
    table = spark.createDataFrame([(i, lang, text, "p", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    found = collocations.collocations(table, least=5, most=25)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 5, 25)
    if small:
        assert collocations.collocations(table.where("1 = 0")).count() == 0


def test_burst_tries_keep_all_counts(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 4)
    rng, trie, wanted = random.Random(1), collocations.HatTrie(), {}
    taken = {}
    for _ in range(400):
        first, rest = rng.randrange(5), [tuple(rng.randrange(6) for _ in range(rng.randrange(1, 4))) for _ in range(3)]
        trie.add(first, rest, [2] * len(rest))
        for key in rest:
            wanted[first, key] = wanted.get((first, key), 0) + 2
        assert trie.total == sum(trie.sizes.values())
        for out, found in trie.taken(60):
            for key, n in found:
                taken[out, key] = taken.get((out, key), 0) + n
    for out, found in trie.taken(0):
        for key, n in found:
            taken[out, key] = taken.get((out, key), 0) + n
    assert taken == wanted and trie.total == 0


def test_groups_are_joined_alike_in_every_way(spark, monkeypatch):
    # a hot key with half of all rows, keys of a few rows, keys without a group, null keys
    rows = [(1 if k % 2 else k // 6, k) for k in range(300)] + [(None, 300), (None, 301)]
    table = spark.createDataFrame(rows, "key long, uid long")
    groups = common.saved(table.groupBy("key").agg(F.count("*").alias("n"), F.max("uid").alias("top")).where("n > 1 and key is not null"), "groups")
    wanted = sorted(map(str, table.join(groups, "key", "left").select("key", "uid", "n", "top").collect()))
    for few, hot in ((1000, 100_000), (0, 10), (0, 1), (0, 100_000)):
        monkeypatch.setattr(common, "FEW", few)
        monkeypatch.setattr(common, "HOT", hot)
        found = common.with_groups(table, groups, ["key"], "n", F.col("uid"))
        assert sorted(map(str, found.select("key", "uid", "n", "top").collect())) == wanted
