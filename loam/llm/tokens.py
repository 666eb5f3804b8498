"""Tokens of a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.session import worker_cache

#: Folder and file of the vocabulary; LOAM_TOKENIZERS names another folder.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts a text into the units of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the tokenizer takes in one go; it can't take runs of any length.
BLANK = 2000
LONG_BLANK = re.compile(r"\s{%d,}" % BLANK)


def vocabulary(path: str | None = None) -> bytes:
    """The content of the vocabulary file, which travels to the executors with the function that needs it (under 1 MB)."""
    path = path or os.path.join(os.environ.get("LOAM_TOKENIZERS", FOLDER), VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


class Tokenizer:
    def __init__(self, content: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("loam", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        if not LONG_BLANK.search(text):
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for m in LONG_BLANK.finditer(text):
            for part in (text[at : m.start()], *[text[i : min(i + BLANK, m.end())] for i in range(m.start(), m.end(), BLANK)]):
                out += self.encoding.encode_ordinary(part)
            at = m.end()
        return out + self.encoding.encode_ordinary(text[at:])

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


def tokenizer(content: bytes) -> Tokenizer:
    """The tokenizer of a vocabulary, made once a worker."""
    cache = worker_cache()
    key = ("tokenizer", hash(content))
    if key not in cache:
        cache[key] = Tokenizer(content)
    return cache[key]


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens; 0 for null. Only the text goes to Python, and only the number comes back."""
    content = vocabulary(path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(content)
        for batch in batches:
            yield pd.Series([t.count(x) for x in batch], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")(text)
