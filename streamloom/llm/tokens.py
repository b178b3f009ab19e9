"""Tokens of a public byte-level BPE tokenizer, whose vocabulary file's directory is a parameter."""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

DIRECTORY = os.environ.get("STREAMLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# fixed value: the pre-token pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in parts, cut before a space between two letters, where tokens always end.
PART = 300_000


#: The pre-token pattern's engine can't follow white space as long as this in one step.
LONG = 10_000
_WHITE = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


class Tokenizer:
    def __init__(self, path: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)
        self.long_white = re.compile(f"{_WHITE}{{{LONG},}}").search

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG and self.long_white(text):
            return self._around_white(text)
        if len(text) <= PART:
            return self.encoding.encode_ordinary(text)
        out, a = [], 0
        while a < len(text):
            b = a + PART
            while b < len(text) and not (text[b] == " " and text[b - 1].isalpha() and text[b + 1 : b + 2].isalpha()):
                b += 1
            out += self.encoding.encode_ordinary(text[a:b])
            a = b
        return out

    def _around_white(self, text: str) -> list[int]:
        """Long white space is one pre-token up to its last character, which the next pre-token begins with."""
        out, a = [], 0
        while m := self.long_white(text[a:]):
            end = a + m.end()
            stop = end - 1 if end < len(text) else end
            out += self.encode(text[a : a + m.start()])
            out += self.encoding._encode_single_piece(text[a + m.start() : stop])
            a = stop
        return out + self.encode(text[a:])

    def count(self, text: str) -> int:
        return len(self.encode(text))


def tokenizer(directory: str = DIRECTORY, vocabulary: str = VOCABULARY) -> Tokenizer:
    """One tokenizer per worker process and file."""
    kept = sys.modules.setdefault("_streamloom_tokenizers", types.ModuleType("_streamloom_tokenizers")).__dict__
    path = os.path.join(directory, vocabulary)
    if path not in kept:
        kept[path] = Tokenizer(path)
    return kept[path]
