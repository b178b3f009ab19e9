"""Cuts oversized texts at natural boundaries into overlapping pieces under a token limit.

Agglomerative: a text is cut into atomic segments at every section, paragraph, row and sentence. Adjacent
segments wait in a heap by the strength of the boundary between them; the weakest boundary is merged away
first, among equals the smallest pair, while the combined size plus the overlap fits. A segment that is
itself too large is first cut between words, and where there are none between characters.

A text can't have more tokens than UTF-8 bytes, so texts of at most ``limit`` bytes are passed over
unread by the tokenizer; all others are tokenized whole.

Defined cases: null and empty texts and texts of at most ``limit`` tokens give no rows; the bodies of a
text's pieces joined in order are the text; every piece but the first begins with the last ``overlap``
tokens of the one before (a few more where a character would be torn); a limit that leaves too little beside
the overlap for any cut is an error; a null id comes out as null and
repeated rows give repeated pieces; ids of any type are kept, other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.tokens import DIRECTORY, VOCABULARY, tokenizer

SECTION, PARAGRAPH, ROW, SENTENCE, WORD, NONE = 5, 4, 3, 2, 1, 0
_STOPS, _CLOSERS = ".!?…", "\"'”’»)]"
_FULL_STOPS = "。！？"
#: Tokens a piece may gain when it is tokenized by itself and cut between whole characters.
_SLACK = 8
_GRAIN = 200


def boundaries(text: str, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token boundary inside the text, its place in characters and its strength (-1: inside a
    character). The first and the last boundary are the text's ends."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(n_bytes)])
    place = np.concatenate([[0], np.cumsum(starts)])[at]
    whole = np.append(starts, True)[at]
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    padded = np.concatenate([np.zeros(2, np.uint32), cp, np.zeros(1, np.uint32)])
    nxt, prev, prior = padded[place + 2], padded[place + 1], padded[place]
    codes = lambda s: np.array([ord(c) for c in s], np.uint32)
    newline, space = np.uint32(10), np.uint32(32)
    out = np.zeros(len(at), np.int64)
    blank = np.isin(nxt, codes(" \t\n")) | np.isin(prev, codes(" \t\n"))
    out[blank] = WORD
    ended = np.isin(prev, codes(_STOPS)) | (np.isin(prev, codes(_CLOSERS)) & np.isin(prior, codes(_STOPS))) | np.isin(prev, codes("}>"))
    out[(ended & (nxt == space)) | np.isin(prev, codes(_FULL_STOPS))] = SENTENCE
    row = (prev == newline) & (nxt != newline)
    out[row] = ROW
    out[row & (prior == newline)] = PARAGRAPH
    out[row & (nxt == ord("="))] = SECTION
    out[~whole] = -1
    return place, out


def merged(sizes: list[int], strengths: list[int], most: int) -> list[int]:
    """Indices at which pieces begin, after merging adjacent segments, weakest boundary first, while the
    combined size is at most ``most``. ``strengths[i]`` is the boundary before segment ``i``."""
    n = len(sizes)
    size, after, before, alive = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strengths[i + 1], sizes[i] + sizes[i + 1], i, i + 1) for i in range(n - 1) if sizes[i] + sizes[i + 1] <= most]
    heapq.heapify(heap)
    while heap:
        strength, both, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or size[i] + size[j] != both:
            continue
        size[i], after[i], alive[j] = both, after[j], False
        k = after[i]
        if k < n:
            before[k] = i
            if both + size[k] <= most:
                heapq.heappush(heap, (strengths[k], both + size[k], i, k))
        h = before[i]
        if h >= 0 and size[h] + both <= most:
            heapq.heappush(heap, (strengths[i], size[h] + both, h, i))
    return [i for i in range(n) if alive[i]]


def segments(strength: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Token places at which atomic segments begin, and the strength of each place."""
    n = len(strength) - 1
    natural = [0, *(np.flatnonzero(strength[1:n] >= SENTENCE) + 1).tolist(), n]
    starts, kinds = [], []
    for a, b in zip(natural[:-1], natural[1:]):
        starts.append(a)
        kinds.append(int(strength[a]))
        while b - a > most:
            grain = min(_GRAIN, most)
            window = strength[a + 1 : a + grain + 1]
            if (words := np.flatnonzero(window >= WORD)).size:
                a += int(words[-1]) + 1
            elif (any_ := np.flatnonzero(window >= NONE)).size:
                a += int(any_[-1]) + 1
            else:  # one character of more tokens than a grain can't be cut
                a += grain + int(np.flatnonzero(strength[a + grain :] >= NONE)[0])
            if a >= b:
                break
            starts.append(a)
            kinds.append(int(strength[a]))
    return starts, kinds


def split_text(text: str, tok, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """``(text start, body start, end, tokens)`` in characters per piece; empty if the text is under the limit."""
    ids = tok.encode(text)
    if len(ids) <= limit:
        return []
    place, strength = boundaries(text, tok.n_bytes[ids])
    most = limit - overlap - _SLACK
    while True:
        starts, kinds = segments(strength, most)
        ends = [*starts[1:], len(ids)]
        kept = merged([b - a for a, b in zip(starts, ends)], kinds, most)
        cuts = [starts[i] for i in kept] + [len(ids)]
        out, excess, began = [], 0, 0
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            s = a
            if n:
                s = max(began, a - overlap)
                while strength[s] < 0:
                    s -= 1
            began = s
            count = tok.count(text[place[s] : place[b]])
            excess = max(excess, count - limit)
            out.append((int(place[s]), int(place[a]), int(place[b]), count))
        if excess <= 0:
            return out
        if most <= 16:
            raise ValueError(f"no pieces of at most {limit} tokens with {overlap} repeated")
        most = max(16, most - excess)


def _split(limit: int, overlap: int, directory: str, vocabulary: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = tokenizer(directory, vocabulary)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                pieces = split_text(text, tok, limit, overlap)
                rows += [i] * len(pieces)
                found += [(n, len(pieces), *p, text[p[0] : p[2]]) for n, p in enumerate(pieces)]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.string()])]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), *columns], ["id", "piece", "n_pieces", "text_start", "body_start", "end", "n_tokens", "text"])

    return run


def split_oversized(
    df: DataFrame, *, item_id: str, text: str, limit: int = 2000, overlap: int = 100,
    directory: str = DIRECTORY, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``item_id, piece, n_pieces, text_start, body_start, end, n_tokens, text`` per piece of every item of
    more than ``limit`` tokens; places are in characters of the item."""
    if not 0 <= overlap < limit - _SLACK - 16:
        raise ValueError("overlap must be smaller than limit")
    rows = df.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, piece int, n_pieces int, text_start bigint, body_start bigint, end bigint, n_tokens int, text string"
    return rows.mapInArrow(_split(limit, overlap, directory, vocabulary), schema).withColumnRenamed("id", item_id)
