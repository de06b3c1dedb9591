"""Edit-aware token counts over pre-token segment trees.

A document is cut into pre-tokens, which are encoded apart; leaves of a segment
tree hold blocks of neighbouring pre-tokens with their characters and token
counts, inner nodes hold sums. An edit finds its leaves from the root, cuts
anew only from the pre-token before it up to where old and new cuts agree
again, encodes what changed, and updates the sums on the way up.

Trees are rows: ``grow_trees`` adds one to each document, ``edit_trees`` applies a
batch of edits and hands the trees on to the next batch, so a table of trees is
kept between batches and no batch cuts or encodes a whole text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh_path, saved, text_of
from .tokenization import encoder

#: Pre-tokens of a fresh leaf, and how many a leaf may hold before the next batch finds the leaves dealt anew.
BLOCK, LARGEST = 32, 256
MEMO_TOKENS = 400_000

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Token counts of pre-tokens, with a bounded memo."""

    def __init__(self, tokenizer: str):
        import regex

        own = encoder(tokenizer)
        self.pattern = regex.compile(own.pattern)
        self.encode = own.count
        self.memo: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        for t in set(tokens):
            if t not in memo:
                memo[t] = self.encode(t)
        return [memo[t] for t in tokens]


def counter(tokenizer: str) -> Counter:
    if tokenizer not in _COUNTERS:
        _COUNTERS[tokenizer] = Counter(tokenizer)
    return _COUNTERS[tokenizer]


class Leaves:
    """Blocks of (characters, tokens) pairs, read from the flat array when they are first touched."""

    def __init__(self, pairs: np.ndarray, sizes: np.ndarray):
        self.pairs, self.ends = pairs, np.cumsum(sizes)
        self.sizes, self.read, self.changed = sizes, {}, set()

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, i: int) -> list[tuple[int, int]]:
        if i >= len(self.sizes):
            raise IndexError(i)
        if i not in self.read:
            self.read[i] = [(n, k) for n, k in self.pairs[self.ends[i] - self.sizes[i] : self.ends[i]].tolist()]
        return self.read[i]

    def __setitem__(self, i: int, pairs: list[tuple[int, int]]) -> None:
        self.read[i] = pairs
        self.changed.add(i)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs and the leaves' sizes, with the changed leaves in their places."""
        if not self.changed:
            return self.pairs, self.sizes
        sizes, parts, at = self.sizes.copy(), [], 0
        for i in sorted(self.changed):
            parts += [self.pairs[at : self.ends[i] - self.sizes[i]], np.array(self.read[i], "<i4").reshape(-1, 2)]
            sizes[i], at = len(self.read[i]), self.ends[i]
        return np.concatenate([*parts, self.pairs[at:]]), sizes


class TokenTree:
    """Segment tree of one document. ``chars`` and ``sums`` are flat, node n has children 2n and 2n + 1."""

    def __init__(self, counter: Counter, text: str, stored: tuple[bytes, bytes, bytes, bytes] | None = None):
        self.counter, self.text = counter, text
        self.encoded = 0  # pre-tokens encoded since the tree was made or read
        if stored:
            pairs, sizes, chars, sums = stored
            self.leaves = Leaves(np.frombuffer(pairs, "<i4").reshape(-1, 2), np.frombuffer(sizes, "<i4"))
            self.chars, self.sums = np.frombuffer(chars, "<i8").copy(), np.frombuffer(sums, "<i8").copy()
            self.width = len(self.chars) // 2
        else:
            tokens = counter.pattern.findall(text)
            self.deal(np.array([*zip(map(len, tokens), counter.counts(tokens), strict=True)], "<i4").reshape(-1, 2))

    def deal(self, pairs: np.ndarray) -> None:
        """Even leaves over the pairs, and all sums."""
        starts = np.arange(0, max(len(pairs), 1), BLOCK)
        self.leaves = Leaves(pairs, np.diff(np.append(starts, len(pairs))).astype("<i4"))
        self.width = 1 << (len(starts) - 1).bit_length()
        nodes = np.zeros((2 * self.width, 2), "<i8")
        if len(pairs):
            nodes[self.width : self.width + len(starts)] = np.add.reduceat(pairs, starts, dtype=np.int64)
        low = self.width
        while low > 1:
            nodes[low // 2 : low] = nodes[low : 2 * low : 2] + nodes[low + 1 : 2 * low : 2]
            low //= 2
        self.chars, self.sums = nodes[:, 0].copy(), nodes[:, 1].copy()

    def stored(self) -> tuple[bytes, bytes, bytes, bytes]:
        """The form in which a later batch reads the tree; leaves that grew large are dealt anew, without encoding."""
        pairs, sizes = self.leaves.flat()
        if sizes.max() > LARGEST:
            self.deal(pairs)
            pairs, sizes = self.leaves.flat()
        return pairs.tobytes(), sizes.tobytes(), self.chars.tobytes(), self.sums.tobytes()

    @property
    def total(self) -> int:
        return int(self.sums[1])

    @property
    def n_pretokens(self) -> int:
        return int(self.leaves.sizes.sum()) + sum(len(self.leaves[i]) - int(self.leaves.sizes[i]) for i in self.leaves.changed)

    def counts_after(self, edits) -> tuple[int, ...]:
        """The fields of ``COUNTS`` once the edits, or none if null, are applied."""
        edits, before = [] if edits is None else edits, self.total
        for e in edits:
            self.edit(int(e["start"] or 0), int(e["removed"] or 0), e["inserted"] or "")
        return len(edits), before, self.total, self.n_pretokens, self.encoded

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last with any, at the end), and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            left = 2 * node
            if at - before < self.chars[left] or not self.chars[left + 1]:
                node = left
            else:
                before += int(self.chars[left])
                node = left + 1
        return min(node - self.width, len(self.leaves) - 1), before

    def set_leaf(self, i: int, pairs: list[tuple[int, int]]) -> None:
        self.leaves[i] = pairs
        node = self.width + i
        more_chars = sum(n for n, _ in pairs) - self.chars[node]
        more = sum(k for _, k in pairs) - self.sums[node]
        while node:
            self.chars[node] += more_chars
            self.sums[node] += more
            node >>= 1

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start`` by ``inserted``; both are clipped to the text."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(start + removed, len(self.text)))
        text = self.text[:start] + inserted + self.text[stop:]
        shift = len(text) - len(self.text)
        # cutting reads one character ahead of a cut at most, so the pre-token that ends before the edit may change too
        first, base = self.find(max(0, start - 1))
        cuts, at = [], base
        for n, _ in self.leaves[first]:
            cuts.append(at)
            at += n
        head = [i for i, c in enumerate(cuts) if c < start]
        keep = max(0, len(head) - 2)
        begin = cuts[keep] if cuts else base
        if keep == 0 and first and begin > 0:  # the pre-token before may lie in an earlier leaf
            first, base = self.find(begin - 1)
            keep, begin = len(self.leaves[first]) - 1, begin - self.leaves[first][-1][0]
        # old cuts behind the edit, read leaf by leaf until a new cut meets one
        last, old_at, i = first, begin, keep
        fresh, at = [], begin
        scan = self.counter.pattern.finditer(text, begin)
        match = next(scan, None)
        while True:
            while last < len(self.leaves) and i >= len(self.leaves[last]):
                last, i = last + 1, 0
            if old_at >= stop and old_at + shift == at and at >= start + len(inserted):
                break
            if last < len(self.leaves) and old_at + shift <= at and (match is None or old_at + shift < match.end()):
                old_at += self.leaves[last][i][0]
                i += 1
            elif match is not None:
                fresh.append(match.group())
                at = match.end()
                match = next(scan, None)
            elif last >= len(self.leaves):
                break
        self.encoded += len(fresh)
        pairs = list(zip(map(len, fresh), self.counter.counts(fresh), strict=True))
        rest = self.leaves[last][i:] if last < len(self.leaves) else []
        self.text = text
        if last == first:
            self.set_leaf(first, self.leaves[first][:keep] + pairs + rest)
        else:
            self.set_leaf(first, self.leaves[first][:keep] + pairs)
            for j in range(first + 1, min(last, len(self.leaves))):
                self.set_leaf(j, [])
            if last < len(self.leaves):
                self.set_leaf(last, rest)


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("inserted", T.StringType())]))
PARTS = ("pairs", "sizes", "chars", "sums")
TREE = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.BinaryType()) for c in PARTS)])
TREE_ARROW = pa.struct([("text", pa.string()), *((c, pa.binary()) for c in PARTS)])
COUNTS = ("n_edits", "n_before", "n_after", "n_pretokens", "n_reencoded")
#: Bytes of text whose trees a task holds as Python objects at once; a longer text is taken alone.
SLICE = 4_000_000


def slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of about ``SLICE`` bytes of text."""
    turn = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(texts)]
    for lo, hi in pairwise(cuts):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def trees_of(rows: list[tuple]) -> pa.Array:
    """Rows (text, *PARTS) as an array of trees."""
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TREE_ARROW, strict=True)], fields=list(TREE_ARROW))


def grow_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, tree), one per document, to be written and kept.

    Null text is empty, a text of any length is one tree, which its task holds
    whole; repeated rows give a row each, columns outside ``keep`` are ignored,
    an empty table gives no rows. Narrow: no shuffle.
    """
    named = docs.select(F.struct(id_col, *keep).alias("row"), text_of(text_col).alias("text"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, batch["text"]):
                trees = trees_of([(t, *TokenTree(own, t).stored()) for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["row"], trees], names=["row", "tree"])

    return named.mapInArrow(grow, T.StructType([named.schema["row"], T.StructField("tree", TREE)])).select("row.*", "tree")


def _after_edits(trees: DataFrame, tokenizer: str, id_col: str, edits_col: str, kind: T.DataType, result: Callable[[list[TokenTree]], pa.Array]) -> DataFrame:
    """Rows (id, *COUNTS, found) of kept trees after their edits, ``found`` what ``result`` makes of the trees of a slice."""
    named = trees.select(F.struct(id_col).alias("row"), F.coalesce(F.col(edits_col).cast(EDITS), F.array().cast(EDITS)).alias("edits"), F.col("tree").alias("tree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, pc.struct_field(batch["tree"], "text")):
                stored = zip(*(pc.struct_field(part["tree"], c).to_pylist() for c in ("text", *PARTS)), strict=True)
                kept = [TokenTree(own, text, parts) for text, *parts in stored]
                counts = [tree.counts_after(edits) for tree, edits in zip(kept, part["edits"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["row"], *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), result(kept)], names=["row", *COUNTS, "found"])

    schema = T.StructType([named.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("found", kind)])
    return named.mapInArrow(run, schema).select("row.*", *COUNTS, "found")


def edit_trees(trees: DataFrame, tokenizer: str, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """Rows (id, n_edits, n_before, n_after, n_pretokens, n_reencoded, tree) of kept trees (id, tree, edits), the trees after the edits.

    ``edits_col`` holds an array of (start, removed, inserted), applied in
    order, each to the text that the one before left. Null edits are none; a null
    field of an edit is 0 or the empty string; ranges are clipped to the text.
    Repeated rows give a row each, other columns are ignored, an empty table
    gives no rows. Narrow: no shuffle; the caller joins edits to trees by id.
    """
    return _after_edits(trees, tokenizer, id_col, edits_col, TREE, lambda kept: trees_of([(t.text, *t.stored()) for t in kept])).withColumnRenamed("found", "tree")


def edited_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Rows (id, n_edits, n_before, n_after, n_pretokens, n_reencoded, edited_sha256), one per document.

    Trees are grown, written as a table, and edited from there in a second
    job, which encodes only what the edits touch; the table is deleted once the
    counts are written. Nulls, repeats, long texts and empty tables as in
    ``grow_trees`` and ``edit_trees``.
    """
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "trees")
    grown = grow_trees(docs, tokenizer, id_col, text_col, (edits_col,))
    grown.write.option("compression", "zstd").parquet(path)
    trees = spark.read.schema(grown.schema).parquet(path)
    digest = lambda kept: pa.array([hashlib.sha256(t.text.encode()).hexdigest() for t in kept], pa.string())
    found = saved(_after_edits(trees, tokenizer, id_col, edits_col, T.StringType(), digest).withColumnRenamed("found", "edited_sha256"), "edited")
    forget(trees)
    return found
