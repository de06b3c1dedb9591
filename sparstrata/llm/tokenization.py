"""Byte-level BPE for tasks."""

from __future__ import annotations

import json

import numpy as np

_ENCODERS: dict[str, ByteEncoder] = {}


def byte_level_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary is a file of the library ``tokenizers``. As it ranks its
    merges in the order of its ids, ``tiktoken`` runs it with equal ids at a
    fraction of the time; special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        byte_of = byte_level_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.pattern = public_tokenizers.PATTERN
        self.tiktoken = tiktoken.Encoding("bytes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.tiktoken.encode_ordinary
        return [np.array(ids(t), dtype="<u4").tobytes() for t in texts]

    def count(self, text: str) -> int:
        return len(self.tiktoken.encode_ordinary(text))


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def text_slices(texts: list, most: int = 4_000_000):
    """Ranges of ``texts`` of about ``most`` characters each, for bounded memory in a task."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
