"""Phrase collocations, counted in burst tries.

A task keeps its counts in a HAT-trie: a shallow trie over word ids whose leaves are
hash containers. A container that grows large bursts into one for each next word;
when the trie holds too many entries, whole subtrees of first words are handed on
as sorted runs. Runs are dealt by language and the first three words, so that a
common first word or pair is spread, and runs of one prefix are merged by sums.

Words are counted first, then pairs, then phrases of three and four words. A phrase
is only as frequent as its rarest part, so tasks count only phrases whose words,
and whose pairs, are frequent. They look these up in Bloom filters of bounded size,
which may let more phrases pass but never lose one. Before pairs are counted, they
are counted by hash: a pair whose hash came too rarely needs no counter of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import saved, text_of

LONGEST = 4
#: Bytes of text that are cut into words at once; longer texts are taken in steps that end at the end of a piece.
STEP = 2_000_000
#: Entries of a container before it bursts, of a trie before subtrees leave it, and words that a task numbers before it starts anew.
BURST, ENTRIES, WORDS = 8192, 500_000, 1 << 20
#: Hashes that a task holds before it sums them up.
HELD = 4_000_000
#: Rows of a run that leave a task at once.
RUN_ROWS = 50_000
#: A part is looked up by broadcast if it has more than this share of all words: no more than so many can have.
HOT_SHARE = 100_000
#: Groups by which the best of a language are found before they meet.
SALTS = 16

ENDS, UPPER = b".,;:!?\n\x0b\x0c\r", bytes(range(0x41, 0x5B))
_TABLE = bytes.maketrans(UPPER + ENDS, UPPER.lower() + b"\n" * len(ENDS))
#: Stands between pieces; no UTF-8 text has this byte.
BREAK = b"\xff"


def word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of batches (lang, text), with ``BREAK`` between pieces; texts of a language are cut together."""

    def cut(lang: str, held: list[bytes]) -> tuple[str, list[bytes]]:
        return lang, (b"\n".join(held) + b"\n").replace(b"\n", b" \xff ").split()

    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, at = text.as_py().translate(_TABLE), 0
            while at < len(data) or not data:
                stop = len(data) if len(data) - at <= STEP else data.find(b"\n", at + STEP)
                stop = len(data) if stop < 0 else stop
                held.setdefault(lang, []).append(data[at:stop])
                sizes[lang] += stop - at
                at = stop + 1
                if sizes[lang] >= STEP:
                    yield cut(lang, held.pop(lang))
                    del sizes[lang]
                if not data:
                    break
        for lang, own in held.items():
            yield cut(lang, own)


class HatTrie:
    """Counts of phrases of word ids: containers {(second, third, fourth): count} under first ids, or under first and second ones once they burst."""

    def __init__(self) -> None:
        self.roots: dict[int, dict] = {}
        self.burst: dict[int, dict[int, dict]] = {}
        self.sizes: Counter = Counter()
        self.total = 0

    def add(self, first: int, rest: list[tuple], counts: list[int]) -> None:
        """Add phrases that begin with one id."""
        if first in self.burst:
            nodes, before = self.burst[first], 0
            for key, n in zip(rest, counts, strict=True):
                own = nodes.setdefault(key[0], {})
                before -= len(own)
                own[key[1:]] = own.get(key[1:], 0) + n
                before += len(own)
            self.sizes[first] += before
            self.total += before
            return
        own = self.roots.setdefault(first, {})
        for key, n in zip(rest, counts, strict=True):
            own[key] = own.get(key, 0) + n
        self.total += len(own) - self.sizes[first]
        self.sizes[first] = len(own)
        if len(own) > BURST:
            del self.roots[first]
            nodes = self.burst[first] = {}
            for key, n in own.items():
                nodes.setdefault(key[0], {})[key[1:]] = n

    def taken(self, most: int) -> Iterator[tuple[int, list[tuple[tuple, int]]]]:
        """Take the largest subtrees out until ``most`` entries are left: (first, [(rest, count)])."""
        for first, size in self.sizes.most_common():
            if self.total <= most:
                break
            if first in self.burst:
                found = [((second, *key), n) for second, own in self.burst.pop(first).items() for key, n in own.items()]
            else:
                found = list(self.roots.pop(first).items())
            del self.sizes[first]
            self.total -= size
            yield first, found


class Ids(dict):
    """Ids of the words of a language, given when a word is first asked for: 0 for those that are not frequent."""

    def __init__(self, numbered: Numbered, lang: str):
        super().__init__({BREAK: 0})
        self.numbered, self.lang, self.mark = numbered, lang, mark_of(lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.numbered.number(self.lang, word, bloom.hash_of(self.mark + word))
        return found


class Numbered:
    """Ids of frequent words of all languages, their hashes and the words themselves."""

    def __init__(self, frequent: np.ndarray):
        # a look-up of one word at a time
        self.frequent, self.mask = frequent.data, 8 * len(frequent) - 1
        self.ids, self.words, self.langs, self.hashed = {}, [b""], [""], np.zeros(1 << 12, np.uint64)

    def number(self, lang: str, word: bytes, value: int) -> int:
        a, b = value & self.mask, value >> 32 & self.mask
        if not (self.frequent[a >> 3] >> (a & 7) & self.frequent[b >> 3] >> (b & 7) & 1):
            return 0
        found = len(self.words)
        self.words.append(word)
        self.langs.append(lang)
        if found == len(self.hashed):
            self.hashed = np.concatenate([self.hashed, np.zeros_like(self.hashed)])
        self.hashed[found] = value
        return found

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        own = self.ids.get(lang)
        if own is None:
            own = self.ids[lang] = Ids(self, lang)
        return np.fromiter(map(own.__getitem__, words), np.int64, len(words))

    @property
    def full(self) -> bool:
        return sum(map(len, self.ids.values())) > WORDS


def mark_of(lang: str) -> bytes:
    return lang.encode() + b"\0"


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes of words, in this order."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> np.uint64(29)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


class PhraseCounter:
    """Counts phrases in a ``HatTrie``: pairs whose bucket is lit, or phrases of three and four words of pairs that a filter holds."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, longer: bool):
        self.frequent, self.pairs, self.longer = words, pairs, longer
        self.fresh()

    def fresh(self) -> None:
        self.numbered, self.trie = Numbered(self.frequent), HatTrie()

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.numbered.of(lang, words)
        hashed = self.numbered.hashed[ids]
        known = (ids[:-1] > 0) & (ids[1:] > 0)
        asked = pair_hash(hashed[:-1][known], hashed[1:][known])
        known[known] = bloom.holds(self.pairs, asked) if self.longer else bloom.lit(self.pairs, asked & np.uint64(8 * len(self.pairs) - 1))
        at = np.flatnonzero(known)
        # pairs are numbered in this batch
        pair, number = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)
        split = np.stack([pair >> 32, pair & 0xFFFFFFFF], axis=1)
        if not self.longer:
            self._insert(split, np.bincount(number.reshape(-1), minlength=len(pair)))
            return
        numbers = np.zeros(len(ids), np.int64)
        numbers[at] = number.reshape(-1)
        three = np.flatnonzero(known[:-1] & known[1:])
        four = three[:-1][np.diff(three) == 1]
        key, n = _counted(numbers[three] << 32 | ids[three + 2])
        self._insert(np.column_stack([split[key >> 32], key & 0xFFFFFFFF]), n)
        key, n = _counted(numbers[four] << 32 | numbers[four + 2])
        self._insert(np.column_stack([split[key >> 32], split[key & 0xFFFFFFFF]]), n)

    def _insert(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Rows of ids, each with its count."""
        if not len(phrases):
            return
        order = np.argsort(phrases[:, 0], kind="stable")
        first, rest, counts = phrases[order, 0], [*zip(*(c[order].tolist() for c in phrases.T[1:]), strict=True)], counts[order].tolist()
        cuts = np.flatnonzero(np.diff(first, prepend=-1))
        for at, stop, own in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)], first[cuts].tolist(), strict=True):
            self.trie.add(own, rest[at:stop], counts[at:stop])

    def runs(self, most: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the subtrees that leave the trie, one behind the other."""
        own, langs, held = self.numbered.words, self.numbered.langs, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            lang, phrase, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

        for first, found in self.trie.taken(most):
            head, lang = own[first] + b" ", langs[first]
            held += sorted((lang, head + b" ".join([own[x] for x in rest]), n) for rest, n in found)
            while len(held) >= RUN_ROWS:
                yield batch(held[:RUN_ROWS])
                del held[:RUN_ROWS]
        if held:
            yield batch(held)


COUNTED = "lang string, phrase string, n long"


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (lang, phrase, n) of all words of texts(lang, text), and one of each language with a null phrase for their sum; counts leave a task summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                own.pop(BREAK, None)
                words = [*own, None]
                columns = [pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([*own.values(), sum(own.values())], pa.int64())]
                yield from pa.Table.from_arrays(columns, ["lang", "phrase", "n"]).to_batches(max_chunksize=50_000)
            held.clear()

        for lang, words in word_runs(batches):
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > ENTRIES:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def pair_filter(texts: DataFrame, words, buckets: int, least: int):
    """A broadcast filter of hashes of pairs of frequent words, of those whose bucket has ``least`` occurrences or more.

    ``buckets`` is a power of two within ``bloom.MOST_BITS``; with too few of them
    more pairs pass.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, held, size = Numbered(words.value), [], 0
        for lang, found in word_runs(batches):
            ids = numbered.of(lang, found)
            known = (ids[:-1] > 0) & (ids[1:] > 0)
            hashed = numbered.hashed[ids]
            held.append((pair_hash(hashed[:-1][known], hashed[1:][known]) & np.uint64(buckets - 1)).astype(np.uint32))
            size += len(held[-1])
            if size >= HELD:
                yield bloom.counted_part(np.concatenate(held))
                held, size = [], 0
            if numbered.full:
                numbered = Numbered(words.value)
        if size:
            yield bloom.counted_part(np.concatenate(held))

    return bloom.collected(texts.sparkSession, bloom.often(texts.mapInArrow(parts, bloom.COUNTED), least), "once", buckets)


def count_phrases(texts: DataFrame, words, pairs, longer: bool) -> DataFrame:
    """Rows (lang, phrase, n) of the pairs whose bucket is lit, or of phrases of three and four words of pairs that a filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PhraseCounter(words.value, pairs.value, longer)
        for lang, found in word_runs(batches):
            own.add(lang, found)
            if own.trie.total > ENTRIES:
                yield from own.runs(ENTRIES // 2)
            if own.numbered.full:
                yield from own.runs(0)
                own.fresh()
        yield from own.runs(0)

    prefix = F.xxhash64("lang", F.substring_index("phrase", " ", 3))
    dealt = texts.mapInArrow(run, COUNTED).withColumn("prefix", prefix).repartition("prefix")
    return dealt.groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("n")).drop("prefix")


def frequent_phrases(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Rows (lang, phrase, n) of all phrases of one to four words with ``least`` occurrences or more, and (lang, n) of all words.

    A null language is ``und``, null and empty texts have no words. Repeated rows
    count as often as they occur.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(f"`{text_col}`").cast("binary").alias("text"))
    words = saved(count_words(texts).where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    single, totals = words.where(F.col("phrase").isNotNull()), words.where(F.col("phrase").isNull()).select("lang", "n")
    n = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = bloom.filter_of(single, ["lang", "phrase"], lambda lang, phrase: bloom.hash_of(mark_of(lang) + phrase.encode()))
    likely = pair_filter(texts, known, max(bloom.SHARD, bloom.filter_bits(int(n), 1) >> 3), least)
    pairs = saved(count_phrases(texts, known, likely, False).where(F.col("n") >= least), "pairs")

    def hashed(lang: str, phrase: str) -> int:
        own = [np.array([bloom.hash_of(mark_of(lang) + w)], np.uint64) for w in phrase.encode().split(b" ")]
        return int(pair_hash(*own)[0])

    known_pairs = bloom.filter_of(pairs, ["lang", "phrase"], hashed)
    longer = saved(count_phrases(texts, known, known_pairs, True).where(F.col("n") >= least), "phrases")
    return single.unionByName(pairs).unionByName(longer), totals


def _parts(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, side, part): for each cut of a phrase after k words its first part and the rest."""
    words = F.split("phrase", " ")
    cut = found.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).where(F.size("w") > 1)
    cut = cut.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    left, right = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")
    sides = F.array(F.struct(F.lit(0).alias("side"), left.alias("part")), F.struct(F.lit(1).alias("side"), right.alias("part")))
    return cut.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")


def _scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by each phrase's lowest-scoring cut."""
    parts = _parts(found)
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    # counts of words sum up to the whole, and those of pairs and longer ones to no more: 4 * HOT_SHARE rows at most
    hot = F.broadcast(counts.where(F.col("f") > whole / HOT_SHARE).withColumnRenamed("f", "hot"))
    rare = counts.where(F.col("f") <= whole / HOT_SHARE)
    marked = parts.join(hot, ["lang", "part"], "left")
    known = marked.where("hot is not null").withColumnRenamed("hot", "f").unionByName(marked.where("hot is null").drop("hot").join(rare, ["lang", "part"]))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = known.groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _held(found: DataFrame) -> DataFrame:
    """(lang, phrase, most): for phrases inside longer ones the largest count of these."""
    words = F.split("phrase", " ")
    longer = found.select("lang", "n", words.alias("w")).where(F.size("w") > 2)
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("w") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")),
        )
    )
    return longer.select("lang", "n", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def _best(table: DataFrame, group: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``most`` strongest phrases of each language.

    Texts lose the case of A-Z and are cut into pieces at ``.,;:!?``, line feeds and
    the like, and pieces into words at blanks and tabs. Phrases of two to four
    words with a occurrences (``least`` or more) inside pieces score
    floor(2000000 a / (l + r)), l and r the occurrences of their parts at the cut
    where that is lowest, the first of such cuts. Phrases inside a longer one with
    ``share`` per cent of their occurrences or more go. n is the number of all
    words. Ties in score go by a, then by the phrase's bytes. A null language is
    ``und``; null and empty texts have no words; repeated rows count each; other
    columns are ignored; an empty table gives no rows.
    """
    found, totals = frequent_phrases(docs, least, text_col, lang_col)
    scored = saved(_scored(found, totals), "scored")
    inner = F.col("most").isNotNull() & (F.col("most") * 100 >= F.col("a") * share)
    left = scored.join(_held(found), ["lang", "phrase"], "left").where(~inner).drop("most")
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    ranked = _best(_best(salted, ["lang", "salt"], most).drop("salt", "rank"), ["lang"], most)
    # a row for each language
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
