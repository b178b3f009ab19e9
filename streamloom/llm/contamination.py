"""Passages of evaluation items in a corpus.

Both sides become words: markup, entities, case, punctuation and layout are taken away. Both are winnowed:
of every window of ``window`` consecutive hashes of ``k`` words the smallest is kept, so every shared span
of ``k + window - 1`` words shares a fingerprint. With 6 and 2 that is 7 words, the longest unchanged
stretch that 30 words with three exchanged, or any longer passage with one word in ten exchanged, must
have.

1. The items' fingerprints become a table, and all their grams a Bloom filter of at most ``MOST_BITS`` bits
   that is sent to the tasks. The filter only spares the shuffle: what it lets through by mistake finds no
   partner later, and a full one lets all pass.
2. One pass over the documents winnows each whole text, and hands on the fingerprints that pass the filter
   in company of as many grams that do as a passage must have, with the words around them, cut into
   overlapping chunks. Copies of a text share its hash from here on.
3. The fingerprints of both sides are joined; a fingerprint that very many documents have (a stock phrase)
   meets the items' rows by the split of hot keys. Each hit is a diagonal of a document and an item, kept
   once per 64 words of the item.
4. The chunks of both sides are joined to each diagonal, which is extended and checked. A passage of 60
   words or more that qualifies has a half that does, so 59 words either way are enough, however long the
   texts.

Running text and what is taken out of it (references, templates, long tags) are each read on their own, so
a reference or template of any name and length may stand inside a passage, and a passage may stand inside
one. Where templates have parameters without a name, the text is also read with these in place. Comments
are no text.

Defined cases: null and empty texts hold nothing; items of fewer than ``least`` words can't be found; a
null ``doc_id`` or ``item_id`` comes out as null; equal items are each reported; repeated rows give one
pair; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.bounds import has_at_most
from streamloom.operators.skew import join_by_key
from streamloom.session import durable

BLOCK = 64
MOST_BITS = 2**27
#: Rows of the items' side up to which a join sends them to the tasks: at most 60 MB of chunks.
FEW = 30_000
_MARKUP = re.compile(r"<!--|<ref\b[^<>]*>|</ref\s*>|\{\{|\}\}", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_ADDRESS = re.compile(r"\[(?:https?:)?//[^\s\]]+")
_PARAMETER = re.compile(r"\|\s*\w+\s*=")
_WORD = re.compile(r"\w+").findall
# soft hyphen, zero-width space, joiners and no-break, word joiner, byte order mark
_HIDDEN = ("\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")
_SEEN = 2_000_000


def readings(text: str) -> list[str]:
    """The running text, and whatever is taken out of it: references, templates and tags, each without what
    is taken out of them in turn. One pass over the markup; what is never closed is running text."""
    if "[" in text:
        text = _ADDRESS.sub(" ", _LINK.sub(r"\1", text))
    out: list[str] = []
    if "<" not in text and "{{" not in text:
        return [text]
    own: list[list[str]] = [[]]  # text of each open unit, without what is taken out of it
    flat: list[list[str]] = [[]]  # the same with nameless parameters in place
    kinds = [""]
    inline = False
    at, closing, ref = 0, True, 0  # ref: the place of the open reference, of which there is one at most

    def add(s: str) -> None:
        own[-1].append(s)
        flat[-1].append(s)

    def dissolve(since: int) -> None:
        """Units from ``since`` on were never closed: their text is that of the unit before them."""
        for x in (own, flat):
            for pieces in x[since:]:
                x[since - 1] += pieces
            del x[since:]
        del kinds[since:]

    for m in _MARKUP.finditer(text):
        if m.start() < at:
            continue
        mark = m.group()
        add(text[at : m.start()])
        at = m.end()
        if mark == "<!--":
            end = text.find("-->", at) if closing else -1
            closing = end >= 0
            if closing:
                add(" ")
                at = end + 3
        elif mark == "{{":
            kinds.append("{")
            own.append([])
            flat.append([])
        elif mark == "}}":
            if kinds[-1] == "{":
                parts = " ".join(flat.pop()).split("|")
                out.append(_PARAMETER.sub("|", " ".join(own.pop())))
                kinds.pop()
                nameless = [p for p in parts[1:] if "=" not in p]
                inline |= any(map(_WORD, nameless))
                own[-1].append(" ")
                flat[-1] += [" ", *nameless, " "]
            else:
                add(" ")
        elif mark[1] == "/":
            if ref:
                dissolve(ref + 1)
                out.append(" ".join(own.pop()))
                flat.pop()
                kinds.pop()
                ref = 0
            add(" ")
        elif mark[-2] == "/":
            add(" ")
        else:
            if ref:  # references don't contain each other, so that one was never closed
                dissolve(ref)
            out.append(mark)
            ref = len(kinds)
            kinds.append("<")
            own.append([])
            flat.append([])
    add(text[at:])
    dissolve(1)
    running = " ".join(own[0])
    out.append(running)
    if inline:
        out.append(" ".join(flat[0]))
    if "{{" in text:
        out[-2 if inline else -1] = _PARAMETER.sub("|", running)
    if "<" in text:
        for i, x in enumerate(list(out)):
            if "<" in x:
                out += [t for t in _TAG.findall(x) if " " in t]
                out[i] = _TAG.sub(" ", x)
    return out


def word_lists(text: str | None, least: int = 1) -> list[list[str]]:
    """The words of every reading of a text that has at least ``least`` of them."""
    if not text:
        return []
    if "&" in text:
        import html

        text = html.unescape(text)
    if not text.isascii():
        import unicodedata

        if any(c in text for c in _HIDDEN):
            text = "".join(c for c in text if c not in _HIDDEN)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    found = []
    for reading in readings(text):
        if len(reading) >= 2 * least - 1:
            reading = reading.lower() if reading.isascii() else reading.casefold()
            words = _WORD(reading.replace("_", " "))
            if len(words) >= least:
                found.append(words)
    return found


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A well mixed hash of every ``k`` consecutive word hashes; the largest value where one is 0 (none)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(k):
            part = ids[j : j + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += part
            known &= part > 0
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h[~known] = np.iinfo(np.uint64).max
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of every window; grams of no words are never kept."""
    if not len(h):
        return np.zeros(0, np.int64)
    window = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    at = np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1)) if window != 2 else np.flatnonzero(np.append(False, h[1:] <= h[:-1]) | np.append(h[:-1] < h[1:], False))
    return at[h[at] != np.iinfo(np.uint64).max]


class _Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _SEEN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1  # never 0
        return h


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of a Bloom filter that belong to each hash."""
    with np.errstate(over="ignore"):
        step = (h >> np.uint64(32)) | np.uint64(1)
        for j in range(4):
            yield (h + np.uint64(j) * step * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)


def may_contain(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter: places, in order."""
    at = np.arange(len(h))
    bits = 64 * len(table)
    for j in range(4):
        if not len(at):
            break
        place = list(_positions(h[at], bits))[j] if j else next(_positions(h[at], bits))
        at = at[(table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def near_passages(inside: np.ndarray, least: int, per: int, k: int) -> np.ndarray:
    """Grams that lie in a stretch which has as many grams in the filter as a passage of its length must
    have: ``e`` exchanged words of ``n`` spoil at most ``k`` grams each of the ``n - k + 1``."""
    total = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    edges = np.zeros(len(total), np.int32)
    for n in range(least, 2 * least):
        grams, wanted = n - k + 1, n - k + 1 - k * (n // per)
        if wanted <= 0:
            return np.ones(len(inside), bool)
        if len(inside) < grams:
            break
        at = np.flatnonzero(total[grams:] - total[:-grams] >= wanted)
        edges[at] += 1  # the places differ from each other
        edges[at + grams] -= 1
    return np.cumsum(edges[:-1]) > 0


class Shape:
    """How texts are cut: an item into blocks with their surroundings, a document into chunks of which one
    holds whatever a block can be laid against."""

    def __init__(self, least: int, k: int):
        self.reach = 2 * least - 1
        self.width = BLOCK + 2 * self.reach + k  # of an item's block with its surroundings
        self.chunk = BLOCK + self.width
        self.lead = -(-(self.reach + BLOCK - 1) // BLOCK) * BLOCK  # places before a document's first word


def _cut(flat: np.ndarray, starts: np.ndarray, width: int):
    """Stretches of ``flat`` as fixed binaries."""
    import pyarrow as pa

    rows = flat[starts[:, None] + np.arange(width)]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


_ROWS = "id bigint, text_key string, part int, words binary, places array<int>, prints array<bigint>"


def _scan(shape: Shape, least: int, per: int, k: int, window: int, table: np.ndarray | None):
    """Texts to chunks with the fingerprints that begin in each: of items (without a filter) every block, of
    documents what lies around fingerprints that pass the filter."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        hashes = _Hashes()
        lead = shape.reach if table is None else shape.lead
        width = shape.width if table is None else shape.chunk

        def found(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Document, place and hash of the fingerprints to be kept."""
            gap = np.zeros(k, np.uint64)
            flat = np.concatenate([x for d in docs for x in (d, gap)])
            begins = np.cumsum([0, *[len(d) + k for d in docs]])[:-1]
            h = gram_hashes(flat, k)
            at = winnow(h, window)
            if table is not None:
                inside = np.zeros(len(h), bool)
                inside[may_contain(table, h)] = True
                at = at[inside[at] & near_passages(inside, least, per, k)[at]]
            doc = np.searchsorted(begins, at, side="right") - 1
            return doc, at - begins[doc], h[at]

        def work(ids: list, keys: list, docs: list[np.ndarray]):
            doc, place, h = found(docs)
            if table is not None:  # what holds no fingerprint of an item is done with
                kept, doc = np.unique(doc, return_inverse=True)
                ids, keys, docs = ([x[i] for i in kept.tolist()] for x in (ids, keys, docs))
            if not docs:
                return
            gap = np.zeros(width + lead, np.uint64)
            flat = np.concatenate([gap, *[x for d in docs for x in (d, gap)]])
            lengths = np.array([len(d) for d in docs], np.int64)
            begins = len(gap) + np.concatenate([[0], np.cumsum(lengths + len(gap))])[:-1]
            most = int(lengths.max()) // BLOCK + 4
            if table is None:
                home = doc * most + place // BLOCK
                blocks = -(-lengths // BLOCK)
                parts = np.repeat(np.arange(len(docs)) * most, blocks) + np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            else:  # a diagonal through the fingerprint begins up to a block and the reach before it
                place = place + lead
                home = doc * most + (place - shape.reach) // BLOCK
                parts = np.unique(np.concatenate([home, doc * most + (place - shape.reach - BLOCK + 1) // BLOCK]))
            order = np.argsort(home, kind="stable")
            offsets = np.append(np.searchsorted(home[order], parts), len(home)).astype(np.int32)
            owner, part = parts // most, parts % most
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[order])) for x in (place.astype(np.int32), h.view(np.int64))]
            cut = _cut(flat, begins[owner] - lead + part * BLOCK, width)
            columns = [pa.array(ids, pa.int64()).take(pa.array(owner)), pa.array(keys, pa.string()).take(pa.array(owner)), pa.array(part.astype(np.int32)), cut, *lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "part", "words", "places", "prints"])

        for batch in batches:
            ids, keys, docs, size = [], [], [], 0
            for name, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                lists = word_lists(text, least)
                if lists:
                    ids.append(name.as_py())
                    keys.append(xxhash.xxh3_128_hexdigest(text))
                    gap = np.zeros(k, np.uint64)  # keeps grams and passages from spanning two readings
                    arrays = [np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws)) for ws in lists]
                    docs.append(arrays[0] if len(arrays) == 1 else np.concatenate([x for a in arrays for x in (a, gap)]))
                    size += len(docs[-1])
                if size > 100_000:
                    yield from work(ids, keys, docs)
                    ids, keys, docs, size = [], [], [], 0
            if ids:
                yield from work(ids, keys, docs)

    return run


def _filter_words(shape: Shape, k: int, bits: int):
    """The bits of all grams of the items' blocks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(batch.num_rows, shape.width)
            h = np.concatenate([gram_hashes(x, k) for x in words[:, shape.reach : shape.reach + BLOCK + k - 1]])
            place = np.concatenate(list(_positions(h[h != np.iinfo(np.uint64).max], bits)))
            word, where = np.unique((place >> np.uint64(6)).astype(np.int64), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, where, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], ["word", "mask"])

    return run


def bloom_filter(blocks: DataFrame, shape: Shape, k: int, n: int) -> np.ndarray:
    """A Bloom filter of all grams of the items' ``n`` blocks, 32 bits for each, at most ``MOST_BITS``, as 64-bit words. It is
    put together by an aggregate; what comes to the driver is the filter itself, ``MOST_BITS / 64`` words at most."""
    bits = min(MOST_BITS, 1 << max(16, (32 * BLOCK * n).bit_length()))
    table = np.zeros(bits // 64, np.uint64)
    found = blocks.select("words").mapInArrow(_filter_words(shape, k, bits), "word int, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return table


def _verified(shape: Shape, least: int, per: int):
    """Diagonals whose words hold a passage: the text keys of both sides."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def matrix(column, width: int) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), width)

        step = np.arange(shape.width)
        for whole in batches:
            for batch in (whole.slice(a, 2000) for a in range(0, whole.num_rows, 2000)):
                shift = batch.column("shift").to_numpy()
                item = matrix(batch.column("item_words"), shape.width)
                doc = np.take_along_axis(matrix(batch.column("words"), shape.chunk), shift[:, None] + step, axis=1)
                gain = np.where((doc == 0) | (item == 0), -100_000, np.where(doc == item, 1, 1 - per)).astype(np.int64)
                total = np.concatenate([np.zeros((len(gain), 1), np.int64), np.cumsum(gain, axis=1)], axis=1)
                lowest = np.minimum.accumulate(total, axis=1)
                at = np.flatnonzero((total[:, least:] >= lowest[:, :-least]).any(1))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("text_key", "item_key")], ["text_key", "item_key"])

    return run


def _join_few(facts: DataFrame, dims: DataFrame, key: str, columns: list[str], few: int, known: int | None = None) -> DataFrame:
    """Inner join with the items' side: sent to the tasks if it is proven small, be it by a number of rows that
    is ``known`` not to be passed, else by the split of hot keys."""
    if (known is not None and known <= few) or has_at_most(dims, few):
        side = F.broadcast(dims.select(F.col(key).alias("__dim_key"), *columns))
        return facts.join(side, F.col(key) == F.col("__dim_key")).drop("__dim_key")
    return join_by_key(facts, dims.withColumn("__there", F.lit(True)), key, [*columns, "__there"]).where("__there").drop("__there")


def find_leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    least: int = 30, per: int = 10, k: int = 6, window: int = 2, few: int = FEW,
) -> DataFrame:
    """``doc_id, item_id`` of every document that contains a passage of the item: ``least`` consecutive
    words or more with at most one in ``per`` exchanged."""
    shape = Shape(least, k)

    def scanned(df: DataFrame, name: str, table: np.ndarray | None) -> DataFrame:
        rows = df.select(F.col(name).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
        return durable(rows.mapInArrow(_scan(shape, least, per, k, window, table), _ROWS))

    def prints_of(rows: DataFrame) -> DataFrame:
        return rows.select("text_key", F.explode(F.arrays_zip("places", "prints")).alias("x")).select("text_key", F.col("x.prints").alias("h"), F.col("x.places").alias("place"))

    blocks = scanned(items, item_id, None)
    of_items = prints_of(blocks)
    dims = of_items.select("h", F.col("text_key").alias("item_key"), F.col("place").alias("item_place")).distinct()
    n = blocks.count()
    chunks = scanned(documents, doc_id, bloom_filter(blocks, shape, k, n))

    hits = _join_few(prints_of(chunks).distinct(), dims, "h", ["item_key", "item_place"], few, BLOCK * n)
    start = F.col("place") - shape.reach - F.pmod("item_place", F.lit(BLOCK))  # where the item's block with its surroundings begins
    diagonals = hits.select(
        "text_key", F.floor(start / BLOCK).cast("int").alias("part"), F.pmod(start, F.lit(BLOCK)).alias("shift"), F.concat_ws(":", "item_key", F.floor(F.col("item_place") / BLOCK)).alias("block_key")
    ).distinct()
    # copies of a text have the same chunks
    words = chunks.groupBy("text_key", "part").agg(F.first("words").alias("words"))
    item_words = blocks.groupBy("text_key", "part").agg(F.first("words").alias("item_words"))
    item_words = item_words.select(F.concat_ws(":", "text_key", "part").alias("block_key"), F.col("text_key").alias("item_key"), "item_words")
    laid = _join_few(diagonals.join(words, ["text_key", "part"]), item_words, "block_key", ["item_key", "item_words"], few, n)
    pairs = laid.select("text_key", "item_key", "shift", "words", "item_words").mapInArrow(_verified(shape, least, per), "text_key string, item_key string").distinct()
    named = _join_few(pairs, blocks.select(F.col("text_key").alias("item_key"), F.col("id").alias("item_id")).distinct(), "item_key", ["item_id"], few, n)
    of_texts = durable(named.select("text_key", "item_id").distinct())
    members = chunks.select("text_key", F.col("id").alias("doc_id")).distinct()
    return _join_few(members, of_texts, "text_key", ["item_id"], few).select("doc_id", "item_id").distinct()
