"""Oversized texts in pieces: balanced targets, snapped to natural boundaries.

With the least number of pieces that can hold the text, the cuts are first placed so that all pieces are equally long;
each is then moved to the strongest boundary nearby (paragraph, line, sentence, clause, word; the nearest of equally
strong ones), as far as the piece before it stays under the limit. Each piece is tokenized by itself; if one is above the
limit, or a cut finds no place, there are more pieces and the text is cut anew."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.tokens import Tokenizer, tokenizer, vocabulary

#: Boundaries from weak to strong: a piece may begin after a match.
BOUNDARIES = tuple(map(re.compile, (r"\s+", r"[,;:]['\"»)\]]*\s+", r"[.!?…]['\"»)\]]*\s+", r"\s*[\r\n]+", r"[ \t]*(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")))
#: How far a cut may move, as a share of a piece.
WINDOW = 0.2
#: Tokens that a piece may have more by itself than as a part of the text.
SAFETY = 8


class Text:
    """A text with the token at which each boundary lies."""

    def __init__(self, text: str, t: Tokenizer, ids: list[int]):
        self.text, self.tokens = text, len(ids)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bytes = np.append(0, np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000).astype(np.int64)))
        self.ends = np.append(0, np.cumsum(t.lengths[np.array(ids, np.int64)]))
        strength = np.zeros(len(text) + 1, np.int8)
        for s, pattern in enumerate(BOUNDARIES, 1):
            strength[[m.end() for m in pattern.finditer(text)]] = s
        strength[[0, -1]] = 0
        self.places = np.flatnonzero(strength)
        self.strength = strength[self.places]
        self.at = self.token(self.places)

    def token(self, places: np.ndarray) -> np.ndarray:
        """Tokens before each character."""
        return np.searchsorted(self.ends, self.bytes[places], "left")

    def character(self, token: float) -> int:
        """The last character boundary at or before a token."""
        return int(np.searchsorted(self.bytes, self.ends[max(0, min(int(token), self.tokens))], "right")) - 1

    def snap(self, target: float, low: float, high: float) -> int:
        """The place of the strongest boundary with low <= token <= high, the nearest to the target of those; without any, the character at the target."""
        a, b = np.searchsorted(self.at, low, "left"), np.searchsorted(self.at, high, "right")
        if a < b:
            best = np.flatnonzero(self.strength[a:b] == self.strength[a:b].max()) + a
            return int(self.places[best[np.abs(self.at[best] - target).argmin()]])
        return self.character(min(max(target, low), high))

    def begin(self, token: float, cut: int, overlap: int) -> int:
        """The first boundary at or after a token and before the cut, as long as half of the overlap is left; without any, the character at the token."""
        a = np.searchsorted(self.at, token, "left")
        if a < len(self.places) and self.places[a] < cut and self.at[a] <= token + overlap / 2:
            return int(self.places[a])
        return min(self.character(math.ceil(token)), cut)


def _cuts(x: Text, n: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """Begin and end of n pieces; None if some cut has no place."""
    length = (x.tokens + (n - 1) * overlap) / n
    out, begin, last = [], 0, 0
    for j in range(1, n):
        target = overlap + j * (length - overlap)
        first = int(x.token(np.array([begin]))[0])
        low = max(target - WINDOW * (length - overlap), int(x.token(np.array([last]))[0]) + 1)
        high = min(target + WINDOW * (length - overlap), first + limit - min(SAFETY, limit // 10), x.tokens - 1)
        if low > high:
            return None
        cut = x.snap(target, low, high)
        if cut <= last:
            return None
        out.append((begin, cut))
        last = cut
        begin = max(x.begin(int(x.token(np.array([cut]))[0]) - overlap, cut, overlap), out[-1][0] + 1) if overlap else cut
    out.append((begin, len(x.text)))
    return out


def split_text(text: str, t: Tokenizer, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, end, tokens) of the pieces, in characters."""
    ids = t.encode(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids))]
    x = Text(text, t, ids)
    n = max(2, math.ceil((len(ids) - overlap) / (limit - overlap)))
    while n < len(text):
        cuts = _cuts(x, n, limit, overlap)
        if cuts and all(x.token(np.array([b]))[0] - x.token(np.array([a]))[0] <= limit for a, b in cuts):
            counts = [t.count(text[a:b]) for a, b in cuts]
            if max(counts) <= limit:
                return [(a, b, c) for (a, b), c in zip(cuts, counts, strict=True)]
        n = max(n + 1, math.ceil(n * 1.02))
    return [(i, i + 1, t.count(text[i])) for i in range(len(text))]


PIECES = "piece_no int, n_pieces int, begin long, end long, n_tokens long, piece string"


def split_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = 1000, overlap: int = 50, path: str | None = None) -> DataFrame:
    """(id, piece_no, n_pieces, begin, end, n_tokens, piece): every text in pieces of at most `limit` tokens.

    begin and end count characters, end excluded; each piece after the first begins `overlap` tokens before the end of the
    one before it, or at the first boundary after that which leaves half of them. A text within the limit is one piece. A null text is one null piece, an empty one
    one empty piece. A piece has one character at least, whatever the limit. Rows without an id are split too; a row that
    comes twice is split twice; other columns are ignored."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    content = vocabulary(path)
    kind = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(content)
        names = ["piece_no", "n_pieces", "begin", "end", "n_tokens", "piece"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def batch_of(ids: pa.Array, row: list[int], rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["id", *names])

        for batch in batches:
            row, rows, size, ids = [], [], 0, batch.column("id")
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                pieces = split_text(text, t, limit, overlap) if text else [(0, 0, 0)]
                for no, (a, b, c) in enumerate(pieces):
                    row.append(i)
                    rows.append((no, len(pieces), a, b, c, text[a:b] if text is not None else None))
                    size += b - a
                if size > 4_000_000:
                    yield batch_of(ids, row, rows)
                    row, rows, size = [], [], 0
            if rows:
                yield batch_of(ids, row, rows)

    out = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(run, f"id {kind}, {PIECES}")
    return out.withColumnRenamed("id", id_column)


def oversized(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids of the texts that had to be cut."""
    return pieces.filter("n_pieces > 1 and piece_no = 0").select(id_column).distinct()
