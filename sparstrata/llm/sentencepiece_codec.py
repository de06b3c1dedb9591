"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

The distinct marked words of a slice of documents are sorted, which lays out
their trie, and walked depth-first: the forward states of a prefix stay on a
stack and serve every word that continues it.

The vocabulary at hand is a merge (BPE) model, whose segmentation is not the
one of the highest summed score. What the forward pass keeps per position is
therefore the last piece of the prefix's only valid segmentation: a piece may
follow another just if merging their joined text leaves these two. Any prefix
of a valid segmentation is valid, so the pass is exact and equals the library's
ids. Models of other types are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, restored, text_of
from .tokenization import text_slices

SPACE = "▁"
MEMO_WORDS = 300_000
MEMO_PAIRS = 400_000

_CODECS: dict[str, Codec] = {}


class Codec:
    """Vocabulary of a model file: ids by piece, and the forward pass."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(s != int(s) for s in self.score.values()):
            raise ValueError("scores are not merge ranks: models of this type have another segmentation")
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece crosses a word mark: words of this model can't be encoded apart")
        # a line end that is in no piece never merges with what is beside it
        ends = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{SPACE}+[^{SPACE}{ends}]*|[^{SPACE}{ends}]+" + (f"|{ends}" if ends else ""))
        self.memo: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text``: the best-scored neighbouring pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def sound(self, piece: int) -> bool:
        """Whether merging the characters of a piece gives the piece."""
        known = self.alone.get(piece)
        if known is None:
            text = self.pieces[piece]
            known = self.alone[piece] = self.merged(text) == [text]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces leaves these two; -1 is an unknown character."""
        if left < 0:
            return self.sound(right)
        a, b = self.pieces[left], self.pieces[right]
        return self.merged(a + b) == [a, b]

    def forward(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of sorted distinct words; states of shared prefixes are computed once."""
        found, before = {}, ""
        # per prefix: the piece that ends its segmentation (-1: a character outside the vocabulary), and where it starts
        last, begins = [-1], [0]
        ids, tails, pairs = self.ids, self.tails, self.pairs
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        for word in words:
            shared = len(commonprefix((before, word)))
            del last[shared + 1 :], begins[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                state, begin, start = -1, end - 1, end - 1
                while start >= 0:
                    text = word[start:end]
                    piece = ids.get(text)
                    if piece is not None:
                        if start:
                            key = last[start] << 32 | piece
                            fits = pairs.get(key)
                            if fits is None:
                                fits = pairs[key] = self.follows(last[start], piece)
                        else:
                            fits = self.sound(piece)
                        if fits:
                            state, begin = piece, start
                            break
                    elif text not in tails:
                        break
                    start -= 1
                last.append(state)
                begins.append(begin)
            out, end = [], len(word)
            while end:
                piece, begin = last[end], begins[end]
                if piece < 0:
                    out.extend(self.bytes[b] for b in reversed(word[begin:end].encode()))
                else:
                    out.append(piece)
                end = begin
            out.reverse()
            found[word] = out
            before = word
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        memo.update(self.forward(sorted({w for words in split for w in words if w not in memo})))
        return [[i for w in words for i in memo[w]] for words in split]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): one per document, no shuffle.

    Null text is empty and has no ids. Null ids and repeated rows give a row
    each; other columns are ignored; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = codec(model).encode
        for pdf in batches:
            keys, texts = pdf["id"], pdf["text"].tolist()
            for lo, hi in text_slices(texts):
                yield pd.DataFrame({"id": keys.iloc[lo:hi].to_numpy(), "ids": encode(texts[lo:hi])})

    found = docs.select(carried(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(run, schema)
    return found.select(restored("id", docs.schema[id_col].dataType).alias(id_col), "ids")


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text). Null ids arrays give null text, ids outside the vocabulary an error."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = codec(model).decode
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": [None if x is None else decode(list(x)) for x in pdf["ids"]]})

    found = encoded.select(carried(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, schema)
    return found.select(restored("id", encoded.schema[id_col].dataType).alias(id_col), "text")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_pieces, ids, decoded_sha256): encoded and decoded again in one narrow pass.

    Null text is empty: no ids, and the digest of nothing. Null ids and repeated
    rows give a row each; other columns are ignored; an empty table gives no rows.
    """
    import hashlib

    schema = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("n_pieces", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for pdf in batches:
            keys, texts = pdf["id"], pdf["text"].tolist()
            for lo, hi in text_slices(texts, 2_000_000):
                ids = own.encode(texts[lo:hi])
                yield pd.DataFrame(
                    {
                        "id": keys.iloc[lo:hi].to_numpy(),
                        "n_pieces": [len(x) for x in ids],
                        "ids": ids,
                        "decoded_sha256": [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids],
                    }
                )

    found = docs.select(carried(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(run, schema)
    return found.select(restored("id", docs.schema[id_col].dataType).alias(id_col), *schema.names[1:])
