"""The operators of the llm subpackage against brute force, on small and awkward tables."""

import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparstrata.llm import edit_counts, exact_dedup, near_dedup, packing, quality, sentence_spans, sentencepiece_codec, suffix_dedup, vector_search, warc
from sparstrata.llm.queries import BYTE_BPE, PIECES, derived_edits

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, id string, key string, node int, kept string, removed string"


def words(rng, n):
    return " ".join(rng.choice(["ab", "cde", "fgh", "ijkl", "mno", "pq", "rstu", "vwx"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(7)
    base = [words(rng, n) for n in (3, 30, 60, 200, 3000)]
    texts = [None, "", "", "x", "née ﬁ 日本 \n\n  a", *base, base[1], base[2], base[3] + " tail", "Lead. " + base[3] + " more", base[4][:5000], "ab " * 400]
    rows = [(i, t, "en" if i % 3 else None, "s", 1, 1, "a", "b", 2, "c", "d") for i, t in enumerate(texts)]
    rows += [rows[7], (None, base[1], "en", *rows[0][3:]), (5, "another text with an id that repeats", "en", *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA)


def empty(df):
    return df.where("1 = 0")


def test_sentencepiece_equals_library(spark, odd):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    texts = sorted(t or "" for _, t in docs.collect())
    found = sentencepiece_codec.encode_pieces(docs, PIECES)
    assert sorted(r.ids for r in found.collect()) == sorted(own.encode(texts, num_threads=1))
    assert sorted(r.text for r in sentencepiece_codec.decode_pieces(found, PIECES).collect()) == texts
    assert sentencepiece_codec.encode_pieces(empty(odd), PIECES).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(odd, keep):
    found = exact_dedup.exact_groups(odd, keep=keep).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(hashlib.sha256((r.text or "").encode()).hexdigest(), []).append(r.doc_id)
    assert len(found) == odd.count()
    order = lambda x: -1 if x is None else x
    for digest, ids in texts.items():
        own = [r for r in found if r.text_sha256 == digest]
        best = (min if keep == "smallest" else max)(ids, key=order)
        assert len(own) == len(ids) and {r.keep_id for r in own} == {best} and sum(r.kept for r in own) == 1
        assert all(r.group_size == len(ids) for r in own)
    assert exact_dedup.drop_exact_copies(odd).columns == odd.columns
    assert exact_dedup.drop_exact_copies(odd).count() == len(texts)
    assert exact_dedup.exact_groups(empty(odd)).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "u", "same"), (1, "u\nv", "same"), (2, None, None), (4, "w", ""), (None, "z", "same"), (5, "é", "日本\r\n\r\n")], "page_id int, url string, html string")
    folder = warc.fresh_path(spark, "warc")
    index = warc.write_bundles(pages, folder, frame_bytes=400)
    found = {r.page_id: r for r in warc.read_bundles(index, folder).collect()}
    kinds = {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in found.items()}
    assert kinds == {3: ("revisit", 1, 4), 1: ("response", None, 4), 2: ("response", None, 0), 4: ("revisit", 2, 0), None: ("response", None, 4), 5: ("response", None, 10)}
    import base64

    assert found[5].payload_digest == base64.b32encode(hashlib.sha1("日本\r\n\r\n".encode()).digest()).decode()
    wanted = spark.createDataFrame([(3,), (5,), (9,)], "page_id int")
    assert sorted(r.page_id for r in warc.lookup(index, folder, wanted).collect()) == [3, 5]
    assert warc.archive_round_trip(pages.where("1 = 0")).count() == 0


def test_packing(odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack_documents(odd, BYTE_BPE, capacity=128).collect()
    by_text = sorted(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r.length for r in rows) == sum(by_text)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(by_text) // 128) + 1
    assert packing.pack_documents(empty(odd), BYTE_BPE).count() == 0


def test_packing_exchanges_between_pools(spark):
    rng = random.Random(3)
    pieces = spark.createDataFrame([(i, rng.randrange(1, 101)) for i in range(4000)], "uid long, length long")
    rows = packing.pack(pieces, 100, pool_pieces=200, fan_in=4).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert len(rows) == 4000 and max(map(sum, bins.values())) <= 100
    bound = packing.lower_bound(np.array([r.length for r in rows]), 100)
    assert bound <= len(bins) <= bound * 1.02


def test_lower_bound_never_exceeds_a_packing():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array([rng.randrange(1, 31) for _ in range(rng.randrange(1, 40))])
        assert packing.lower_bound(lengths, 30) <= packing.best_fit_decreasing(lengths, 30)[0].max() + 1


def test_sentence_spans(spark):
    shared = "One two three four. Five six seven eight! Nine ten eleven twelve? Thirteen more words."
    docs = [(1, f"Alpha beta. {shared} Omega one."), (2, f"Other start here. {shared} Other end."), (3, None), (4, "Short."), (5, "Short."), (6, "No repeat at all here. None there. And none in this.")]
    found = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert found[1].text == docs[0][1] and found[6].n_removed == 0 and found[3].text == ""
    assert found[2].text == "Other start here. Other end." and found[5].text == "" and found[4].text == "Short."


@pytest.mark.parametrize("sizes", [(55,), (60,), (25, 30), (50, 4), (4, 50), (20, 15, 17), (48, 3, 4), (3, 4, 46), (14, 30, 14)])
def test_passages_of_few_sentences(spark, sizes):
    rng = random.Random(sum(sizes))
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    whole = " ".join(fresh(n) + "." for n in sizes)
    line = whole.replace(".", "") if len(sizes) == 1 else whole
    # in longer documents, a document of its own, and cut in mid-sentence at both ends
    docs = [f"{fresh(9)}. {whole} {fresh(7)}.", f"{fresh(12)}. {fresh(3)}! {whole} {fresh(20)}.", whole, f"{fresh(5)}.\n{line}\n{fresh(8)}.", f"{fresh(6)} of. {fresh(30)}."]
    cut = f"{fresh(6)}. {whole} {fresh(6)}"
    docs += [f"{fresh(9)} {cut} {fresh(9)}.", f"{fresh(4)} {cut} {fresh(5)}."]
    found = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")).collect()}
    assert found[0].text == docs[0] and found[4].text == docs[4] and found[2].text == ""
    assert all(found[i].n_removed == len(sizes) and found[i].text == docs[i].replace(whole + " ", "").replace(line + "\n", "") for i in (1, 3, 5, 6))


def test_spans_cover_whole_repeats():
    rng = random.Random(5)
    for _ in range(300):
        sizes = [rng.randrange(1, 25) for _ in range(rng.randrange(1, 15))]
        spans = sentence_spans.spans_in(sizes)
        cheap = [(a, b) for a, b in combinations(range(len(sizes) + 1), 2) if sum(sizes[a:b]) >= sentence_spans.LEAST]
        least = sentence_spans.LEAST
        wanted = {(a, b) for a, b in cheap if sum(sizes[a : b - 1]) < least or sum(sizes[a + 1 : b]) < least}
        assert spans == (sorted(wanted) or [(0, len(sizes))])
        for a, b in cheap:
            assert {i for s, e in spans if a <= s and e <= b for i in range(s, e)} == set(range(a, b))


@pytest.mark.parametrize("mark", ['.),', '."[3]', '.)x', '!"-', "?'],", '...").'])
def test_sentences_with_closing_marks_inside(mark):
    text = f"\n He lives here (in the U.S{mark} but works there. Fine.\n\nLast{mark}"
    tiles = [text[a:b] for a, b in sentence_spans.sentences(text)]
    first = [f"He lives here (in the U.S{mark} but works there. "] if mark[-1] != "." else [f"He lives here (in the U.S{mark} ", "but works there. "]
    assert tiles == ["\n ", *first, "Fine.\n\n", f"Last{mark}"]


def test_quality_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("en", "abcab cab abac"), ("en", "bca cba"), ("de", "xyz")], "lang string, text string")
    models = quality.train(docs)
    context = quality.grams("abc")[1] & quality._MASK[3]
    symbols = [r.gram for r in models[0][0].where("lang = 'en'").collect()]
    asked = [("en", int(context << 16 | s)) for s in symbols]
    total = sum(r.p for r in quality.probabilities(spark.createDataFrame(asked, "lang string, gram long"), models).collect())
    unseen = quality.probabilities(spark.createDataFrame([("en", int(context << 16 | 0x2603))], "lang string, gram long"), models).first().p
    assert math.isclose(total + unseen, 1.0, rel_tol=1e-9)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id") % 2 == 0
    judged = quality.classify(docs, labels.where(half)).join(labels.where(~half), "doc_id")
    share = {r.quality: r.k for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.985 and share[0] < 0.2


def brute_perplexity(trusted, text):
    """Interpolated modified Kneser-Ney of order 4 by dictionaries, as the textbook has it."""
    from collections import Counter, defaultdict

    pad = lambda t: "\1\1\1" + t
    counts = {4: Counter(p[i : i + 4] for t in trusted for p in [pad(t)] for i in range(len(t)))}
    for n in (3, 2, 1):
        before = defaultdict(set)
        for g in counts[n + 1]:
            before[g[1:]].add(g[0])
        counts[n] = Counter({g: len(x) for g, x in before.items()})
    cut = {}
    for n, table in counts.items():
        of = [sum(c == k for c in table.values()) for k in range(5)]
        y = of[1] / max(of[1] + 2 * of[2], 1)
        sound = of[1] and of[2] and of[3]
        cut[n] = [None] + [min(max(k - (k + 1) * y * of[k + 1] / max(of[k], 1), 0.05), k - 0.05) if sound else 0.75 for k in (1, 2, 3)]
    heads = {n: defaultdict(list) for n in counts}
    for n, table in counts.items():
        for g, c in table.items():
            heads[n][g[:-1]].append(c)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        seen = heads[n].get(g[:-1])
        if seen is None:
            return p(g[1:])
        weight = sum(cut[n][min(c, 3)] for c in seen) / sum(seen)
        own = counts[n].get(g, 0)
        return (max(own - cut[n][min(own, 3)], 0) / sum(seen) if own else 0) + weight * p(g[1:])

    return math.exp(-sum(math.log(p(pad(text)[i : i + 4])) for i in range(len(text))) / len(text)) if text else None


def test_perplexity_against_brute_force(spark):
    rng = random.Random(43)
    good = ["".join(rng.choice("abcde  ") for _ in range(rng.randrange(5, 120))) for _ in range(40)]
    texts = good + ["zzzz", "abc cab \u2603", None, "", "e", good[0], "b" * 3000]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(100, "xyz", "de", 2), (None, "abc", None, 3), ((1 << 60) + 1, "abc", "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").coalesce(1)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100, 0), (None, 1), (41, 1), (41, 0)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == len(rows) and sum(r.trusted for r in found.values()) == 40
    for i, text in enumerate(texts):
        wanted = brute_perplexity(good, text)
        assert found[i].perplexity is wanted if wanted is None else math.isclose(found[i].perplexity, wanted, rel_tol=1e-5), i
    assert found[42].kept and found[43].kept and found[100].perplexity is None and found[None].kept
    assert not found[40].kept


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 1), (None, 1)], "doc_id long, quality int")
    assert quality.classify(odd, labels).count() == odd.count()
    assert quality.drop_poor(odd, labels).columns == odd.columns
    assert quality.classify(odd, empty(labels)).where("kept").count() == odd.count()
    assert quality.classify(empty(odd), labels).count() == 0


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, 2.0]), (None, [1.0] * 16), (40, vectors[40].tolist())]
    found = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=10).collect()
    hits = 0
    for q in range(0, 600, 20):
        if q == 40:
            continue
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = {int(x) for x in np.argsort(-scores)[:10]}
        own = [r for r in found if r.query_id == q]
        assert [r.rank for r in sorted(own, key=lambda r: r.rank)] == list(range(1, 11))
        hits += len(best & {r.vec_id for r in own})
    assert hits >= 0.9 * 290 and not {r.query_id for r in found} & {1000, 1020, 1040}


def jaccard_classes(texts):
    sets = []
    for t in texts:
        w = near_dedup.WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        same = sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        if same and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))]


def test_near_groups(spark):
    rng = random.Random(11)
    texts = [None, "", "one two", "One, two!"]
    for _ in range(12):
        base = words(rng, rng.randrange(20, 200)).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r for r in near_dedup.near_groups(docs).collect()}
    assert [found[i].class_id for i in range(len(texts))] == jaccard_classes(texts)
    assert all(found[i].kept == (found[i].class_id == i) for i in found)


def test_near_groups_with_a_shared_passage(spark):
    rng = random.Random(29)
    passage = words(rng, 80)
    # alike by the passage alone (about 0.5), a group around one text with more or fewer edits, and some that differ in one edit only
    texts = [f"{words(rng, 22)} {passage} {words(rng, 22)}" for _ in range(120)]
    base = words(rng, 150).split()
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    for t in texts[:20]:
        texts.append(t.rsplit(" ", 1)[0] + " otherwise")
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    assert [found[i] for i in range(len(texts))] == jaccard_classes(texts)


@pytest.mark.parametrize("weighted", [False, True])
def test_bounds_leave_similar_pairs(spark, weighted):
    rng = np.random.default_rng(31)
    sets = []
    for _ in range(40):
        base = rng.choice(400, 60, replace=False)
        for _ in range(3):
            own = np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.choice(2000, 4) + 1000]))
            counts = rng.integers(1, 4, len(own)) if weighted else np.ones(len(own), int)
            sets.append(dict(zip(own.tolist(), counts.tolist(), strict=True)))
    rows = [(i, sum(s.values()), list(s), list(s.values())) for i, s in enumerate(sets)]
    table = near_dedup.common_sets(spark.createDataFrame(rows, "uid long, size long, shingles array<long>, counts array<long>"), 0.8)
    members = table.select(F.lit(0).alias("bucket"), "uid", "size", "mass", "sketch")
    other = members.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("uid", "size", "mass", "sketch")])
    pairs = members.join(other, "bucket").where("uid < other_uid").where(near_dedup.comparable(0.8)).select(F.col("uid").alias("a"), F.col("other_uid").alias("b"))
    found = {(r.a, r.b) for r in near_dedup.similar(pairs, table, 0.8).collect()}

    def close(x, y):
        both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
        return both >= 0.8 * (sum(x.values()) + sum(y.values()) - both)

    assert found == {(i, j) for i, j in combinations(range(len(sets)), 2) if close(sets[i], sets[j])}
    assert pairs.count() < 0.2 * math.comb(len(sets), 2)


def test_near_groups_odd(odd):
    found = near_dedup.near_groups(odd)
    assert found.count() == odd.count()
    texts = [r.text for r in odd.orderBy("doc_id", "text").collect()]
    assert found.where("kept").select("key").distinct().count() == len(set(jaccard_classes(texts)))
    assert near_dedup.drop_near_copies(odd).columns == odd.columns
    assert near_dedup.near_groups(empty(odd)).count() == 0


def test_dart_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    k = 4096
    samples = near_dedup.dart_signatures(np.array([300, 300]), np.concatenate([elements, elements]), np.concatenate([x, y]), k)
    wanted = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((samples[0] == samples[1]).mean() - wanted) < 0.03


def brute_cover(datas, length):
    seen, out = set(), []
    for data in datas:
        covered = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            if part in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(part)
        out.append(bytes(covered))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, hot):
    rng = random.Random(13)
    passages = [words(rng, 40) for _ in range(4)]
    texts = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            text += p[a : a + rng.randrange(60, 240)] + words(rng, rng.randrange(0, 8))
        texts.append(text)
    texts += [texts[3], "ab" * 300, "é" * 150, None, ""]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), hot=hot).collect()}
    datas = [(t or "").encode() for t in texts]
    for i, (data, covered) in enumerate(zip(datas, brute_cover(datas, 100), strict=True)):
        assert found[i].kept == bytes(x for x, c in zip(data, covered, strict=True) if not c)
        assert len(found[i].removed) == len(covered.replace(b"\0", b" ").split())


def test_suffix_dedup_with_colliding_places(spark):
    rng = random.Random(23)
    anchor = lambda t: int(suffix_dedup.anchor_runs([t.encode()])[2][0])
    common = words(rng, 60)[:100]
    twin = next(t for t in iter(lambda: words(rng, 60)[:100], None) if anchor(t) == anchor(common))
    # ids with which the two texts share the 40 bits of their keys
    by = lambda t, name: spark.range(1 << 21).select(F.col("id").alias(name), F.shiftright(F.xxhash64("id", F.lit(t)), suffix_dedup.PLACE_BITS).alias("bits"))
    pair = by(common, "a").join(by(twin, "b"), "bits").where("a <> b").first()
    docs = [(pair.a, common), (pair.b, twin), (1 << 22, twin)] + [((1 << 22) + i, common) for i in range(1, 6)]
    docs += [((1 << 23) + i, t) for i, t in enumerate(2 * [words(rng, 60)[:100] for _ in range(300)])]
    found = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=2).collect()}
    assert found[pair.b] == twin.encode() and found[1 << 22] == b""
    assert sum(len(k) > 0 for k in found.values()) == 302


def test_suffix_dedup_odd(odd):
    found = suffix_dedup.remove_repeats(odd, carry=True)
    assert found.count() == odd.count()
    assert found.select("row.*").columns == odd.columns
    assert suffix_dedup.remove_repeats(empty(odd)).count() == 0


def test_token_trees_follow_random_edits():
    rng = random.Random(17)
    own = edit_counts.Counter(BYTE_BPE)
    pieces = ["the", " and", "  ", "\n", "'ll", "é", " 12", "!?", " x", "\t", "don't", " "]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 300)))
        tree = edit_counts.TokenTree(own, text)
        for _ in range(12):
            start, gone = rng.randrange(0, len(text) + 1), rng.randrange(0, 9)
            new = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 4)))
            text = text[:start] + new + text[min(len(text), start + gone) :]
            tree.edit(start, gone, new)
            assert tree.text == text
            assert tree.total == own.encode(text)
            assert [n for leaf in tree.leaves for n, _ in leaf] == [len(t) for t in own.pattern.findall(text)]


def test_trees_are_kept_between_batches(spark, odd, tmp_path):
    # three batches, each on the trees that the one before wrote; a large insertion makes leaves be dealt anew
    rng = random.Random(19)
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    own = edit_counts.Counter(BYTE_BPE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    edit_counts.grow_trees(docs, BYTE_BPE).write.parquet(f"{tmp_path}/0")
    for batch in range(3):
        rows = []
        for i, text in texts.items():
            edits = []
            for _ in range(rng.randrange(0, 4)):
                start, gone = rng.randrange(0, len(text) + 1), rng.randrange(0, 30)
                new = words(rng, 400 if rng.random() < 0.1 else rng.randrange(0, 3))
                text = text[:start] + new + text[start + gone :]
                edits.append((start, gone, new))
            texts[i] = text
            rows.append((i, edits))
        edits = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("edits", edit_counts.EDITS)]))
        trees = spark.read.parquet(f"{tmp_path}/{batch}").join(edits, "doc_id", "left")
        found = edit_counts.edit_trees(trees, BYTE_BPE)
        found.select("doc_id", "tree").write.parquet(f"{tmp_path}/{batch + 1}")
        counts = {r.doc_id: r for r in found.select("*", "tree.text").drop("tree").collect()}
        for i, text in texts.items():
            assert counts[i].text == text
            assert counts[i].n_after == own.encode(text)
            assert counts[i].n_pretokens == len(own.pattern.findall(text))
        few = next(i for i, t in texts.items() if len(t) > 9000)
        edited = sum(len(e[2]) for e in dict(rows)[few])
        assert counts[few].n_reencoded <= edited + 40  # never the whole text


def test_edited_counts_odd(odd):
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("removed"), F.lit(None).cast("string").alias("inserted")))
    found = edit_counts.edited_counts(odd.withColumn("edits", F.when(F.col("doc_id") > 3, edits)), BYTE_BPE)
    assert found.count() == odd.count()
    assert found.where("doc_id = 3").first().n_edits == 0


def test_edited_counts_against_brute_force(spark, odd):
    rng = random.Random(23)
    long = "".join(rng.choice(["the ", "é", "\n\n", "12", " don't", "x" * 40]) for _ in range(400_000))  # a text of several MB
    docs = odd.select("doc_id", "text", "source", "lang").unionByName(spark.createDataFrame([(901, long, "web", "en"), (902, "a" * 300_000, None, "en")], "doc_id long, text string, source string, lang string"))
    given = derived_edits(docs).select("doc_id", "text", "edits").collect()
    found = edit_counts.edited_counts(derived_edits(docs), BYTE_BPE).collect()
    own, wanted = edit_counts.Counter(BYTE_BPE), []
    for r in given:
        text = before = r.text or ""
        for e in r.edits:
            at = min(max(e.start or 0, 0), len(text))
            text = text[:at] + (e.inserted or "") + text[at + (e.removed or 0) :]
        digest = hashlib.sha256(text.encode()).hexdigest()
        wanted.append((str(r.doc_id), len(r.edits), own.encode(before), own.encode(text), len(own.pattern.findall(text)), digest))
    assert sorted((str(r.doc_id), r.n_edits, r.n_before, r.n_after, r.n_pretokens, r.edited_sha256) for r in found) == sorted(wanted)
    assert {r.doc_id: r.n_reencoded for r in found}[901] < 400  # never the whole text


BIG = [None, (1 << 60) + 1, (1 << 60) + 3]


@pytest.fixture(scope="module")
def big(spark):
    """Ids that a double cannot hold, beside a null one, in one batch; texts that share a passage."""
    rng = random.Random(37)
    passage = words(rng, 60)
    return spark.createDataFrame([(i, f"{words(rng, 3)}. {passage}. {words(rng, 3)}.") for i in BIG], "doc_id long, text string").coalesce(1)


def test_ids_pass_unchanged(big):
    ids = lambda df, c="doc_id": sorted((r[c] for r in df.collect()), key=str)
    wanted = sorted(BIG, key=str)
    assert ids(sentencepiece_codec.round_trip(big, PIECES)) == wanted
    encoded = sentencepiece_codec.encode_pieces(big, PIECES)
    assert ids(encoded) == wanted and ids(sentencepiece_codec.decode_pieces(encoded, PIECES)) == wanted
    assert sorted(set(ids(packing.pack_documents(big, BYTE_BPE))), key=str) == wanted
    assert ids(near_dedup.near_groups(big)) == wanted
    assert ids(edit_counts.edited_counts(big.withColumn("edits", F.lit(None).cast(edit_counts.EDITS)), BYTE_BPE)) == wanted
    pages = big.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))
    pages = pages.unionByName(pages.where(f"page_id = {BIG[1]}").withColumn("page_id", F.lit((1 << 60) + 5))).coalesce(1)
    found = warc.archive_round_trip(pages)
    assert ids(found, "page_id") == sorted([*BIG, (1 << 60) + 5], key=str)
    assert ids(found, "refers_to").count(None) == 3 and BIG[1] in ids(found, "refers_to")


def test_cuts_with_big_ids(big):
    spans = {r.doc_id: r.n_removed for r in sentence_spans.remove_repeated_spans(big).collect()}
    assert spans == {None: 0, BIG[1]: 1, BIG[2]: 1}
    texts = [r.text.encode() for r in big.orderBy("doc_id").collect()]
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(big).collect()}
    for i, data, covered in zip(BIG, texts, brute_cover(texts, 100), strict=True):
        assert kept[i] == bytes(x for x, c in zip(data, covered, strict=True) if not c)
    assert len(kept[BIG[2]]) < 100


def test_piece_is_int(odd):
    assert dict(packing.pack_documents(odd, BYTE_BPE).dtypes)["piece"] == "int"


def brute_spans(texts, least):
    """Sentence numbers that go, from the rule's own words: every run of sentences that is a shortest one at one of its ends."""
    found = []
    for t in texts:
        keys = [(i, k) for i, (a, b) in enumerate(sentence_spans.sentences(t or "")) if (k := sentence_spans.sentence_key((t or "")[a:b]))]
        n = [len(k.split()) for _, k in keys]
        runs = [(a, b) for a, b in combinations(range(len(n) + 1), 2) if sum(n[a:b]) >= least and (sum(n[a : b - 1]) < least or sum(n[a + 1 : b]) < least)]
        runs = runs if sum(n) >= least else [(0, len(n))] if n else []
        found.append([(tuple(k for _, k in keys[a:b]), keys[a][0], keys[b - 1][0] + 1) for a, b in runs])
    first, gone = {}, []
    for d, runs in enumerate(found):
        gone.append(set())
        for text, a, b in sorted(runs, key=lambda r: r[1]):
            if first.setdefault(text, (d, a)) != (d, a):
                gone[-1].update(range(a, b))
    return gone


@pytest.mark.parametrize("hot", [sentence_spans.HOT_PLACES, 2])
def test_spans_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sentence_spans, "HOT_PLACES", hot)
    rng = random.Random(41)
    pool = [words(rng, rng.randrange(2, 14)) for _ in range(60)]
    texts = []
    for _ in range(80):
        at = rng.randrange(0, 50)
        body = [words(rng, rng.randrange(1, 12)) for _ in range(3)] + pool[at : at + rng.randrange(0, 8)] + [words(rng, 4)]
        texts.append("".join(s + rng.choice([". ", "! ", "\n", '."  ', " "]) for s in body))
    texts += [None, "", texts[3], pool[0], pool[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(docs).collect()}
    for i, gone in enumerate(brute_spans(texts, sentence_spans.LEAST)):
        tiles = sentence_spans.sentences(texts[i] or "")
        assert found[i].n_removed == len(gone)
        assert found[i].text == "".join(texts[i][a:b] for k, (a, b) in enumerate(tiles) if k not in gone)


def test_spans_odd(odd):
    found = sentence_spans.remove_repeated_spans(odd)
    assert found.count() == odd.count() and found.where("doc_id = 4").first().text == "née ﬁ 日本 \n\n  a"
    assert sentence_spans.remove_repeated_spans(empty(odd)).count() == 0


def test_vectors_of_all_magnitudes(spark):
    rng = np.random.default_rng(47)
    vectors = rng.normal(size=(200, 8)) * 10.0 ** rng.choice([-150, -20, 0, 0, 0, 3, 140], (200, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = vector_search.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), every=20, k=10).collect()
    for q in range(0, 200, 20):
        scores = vectors @ vectors[q]
        best = sorted((i for i in range(200) if i != q), key=lambda i: (-scores[i], i))[:10]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == best and all(math.isclose(r.score, scores[r.vec_id], rel_tol=1e-12) for r in own)


def test_vector_search_odd(spark):
    schema = "vec_id int, embedding array<double>, rank int, score string, query_id int, uid int"
    rows = [(i, [float(i % 7), 1.0], 1, "s", 2, 3) for i in range(50)] + [(20, [0.0, 1.0], 1, None, 2, 3), (60, [1.0, 1.0, 1.0], 1, "s", 2, 3)]
    table = spark.createDataFrame(rows, schema)
    found = vector_search.nearest(table, every=20, k=5).collect()
    assert found[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}
    # equal products by the smaller id; a row that repeats a query's id is a candidate; no other vector has three components
    best = sorted(((-(40 % 7) * (i % 7) - 1, i) for i in range(50) if i != 40))[:5]
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 40), key=lambda r: r.rank)] == [i for _, i in best]
    assert [r.vec_id for r in found if r.query_id == 20 and r.rank == 1] == [6, 0]
    assert {r.query_id for r in found} == {0, 20, 40}
    assert vector_search.nearest(empty(table), every=20, k=5).count() == 0


def test_runs_of_anchors_over_many_batches(spark):
    rng = random.Random(53)
    common = words(rng, 40)
    docs = [(i, words(rng, 4) + common + words(rng, 4)) for i in range(150)] + [(200 + i, words(rng, 60)) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id int, text string"), hot=20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    datas = [t.encode() for _, t in docs]
    for (i, _), data, covered in zip(docs, datas, brute_cover(datas, 100), strict=True):
        assert found[i] == bytes(x for x, c in zip(data, covered, strict=True) if not c)


def test_warc_odd(spark):
    import re

    rng = random.Random(59)
    html = ["<p>same</p>", "x", "", None, words(rng, 9000), "a\r\n\r\nb"]
    rows = [(i, rng.choice(["http://a/é", None, "u\r\nX-Page-ID: 9", ""]), rng.choice(html), "x", "y", 5) for i in range(60)] + [(3, "http://again", html[0], "x", "y", 5)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, id string, record_type string, refers_to int")
    folder = warc.fresh_path(spark, "warc")
    index = warc.write_bundles(pages, folder, frame_bytes=5000, bundle_bytes=20000)
    found = warc.read_bundles(index, folder).collect()
    assert len(found) == len(rows) and dict(warc.read_bundles(index, folder).dtypes)["page_id"] == "int"
    smallest = {}
    for i, _, h, *_ in rows:
        smallest[h or ""] = min(i, smallest.get(h or "", i))
    texts = {(i, (h or "").encode()) for i, _, h, *_ in rows}
    by_digest = {hashlib.sha1(h.encode()).hexdigest(): i for h, i in smallest.items()}
    import base64

    for r in found:
        first = by_digest[base64.b32decode(r.payload_digest).hex()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert any(i == r.page_id and len(h) == r.payload_bytes for i, h in texts)
    wanted = spark.createDataFrame([(3,), (3,), (40,), (None,), (999,)], "page_id int")
    looked = warc.lookup(index, folder, wanted).collect()
    key = lambda r: (r.record_id, r.url)
    assert sorted(map(key, looked)) == sorted(key(r) for r in found if r.page_id in (3, 40))
    assert not any(re.search(r"[\r\n]", r.url) for r in found)


def test_edits_and_packing_odd(odd):
    assert edit_counts.edited_counts(empty(odd).withColumn("edits", F.lit(None).cast(edit_counts.EDITS)), BYTE_BPE).count() == 0
    found = packing.pack_documents(odd, BYTE_BPE)
    assert found.where("doc_id is null").count() == 1 and found.columns[:2] == ["doc_id", "piece"]


def test_other_models_are_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "get_score", lambda self, i: -0.5 - i)
    with pytest.raises(ValueError):
        sentencepiece_codec.Codec(PIECES)


def test_pipeline_on_an_awkward_table(spark, odd, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    for name, table in (("documents", odd), ("labels", labels)):
        table.write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        out.write.parquet(f"file://{tmp_path}/out-{name}")
        assert stage(spark, empty(docs), f"file://{tmp_path}").count() == 0
        out = spark.read.parquet(f"file://{tmp_path}/out-{name}")
        if name != "packing":
            assert out.columns == odd.columns
            docs = out
    texts = [r.text or "" for r in docs.collect()]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE_BPE)
    rows = out.collect()
    assert sum(r.length for r in rows) == sum(len(own.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    # what is left repeats no string of 100 bytes, and near copies went before
    assert not any(any(c) for c in brute_cover([t.encode() for t in texts], 100)) and len({t for t in texts if t}) == len([t for t in texts if t])
    whole = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    key = lambda r: (str(r.doc_id), r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, rows))
