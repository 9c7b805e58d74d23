"""Benchmark passages in training text, by an FM-index of the words of each shard.

A-Z is lower-cased; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A phrase is `window` consecutive
words of an item; an item of fewer words, but not none, is one phrase. Each worker turns the
documents it reads into shards of words, coded by the shard's own vocabulary, and indexes them:

- documents are cut into segments that overlap by window - 1 words, each closed by an end of its
  own, so a phrase lies in one segment whole, and sorting suffixes by doubling takes a few rounds
  whatever the length of a document or the number of copies of a passage;
- the suffixes' preceding words are kept in a wavelet matrix; phrases of all items step backwards
  through it at once, by ranks;
- rows found are traced back by ranks to a sampled suffix position.

Occurrences are merged to spans of words and of code points. Nothing is shuffled. Benchmarks go to the
tasks in blocks of bounded bytes, compressed; each shard is indexed once and searched for one block
after the other. What a task holds is one shard, one block, and the compressed blocks: a benchmark of
1 GB is some 300 MB of them.

Null texts and texts without words have no words; nulls and empty items have no phrases. Rows of
one item_id are one item; a null item_id counts as the empty string. Repeated documents each get
their row. Very long texts are indexed in several shards that overlap by window - 1 words. An empty
benchmark leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantail.llm.common import byte_slices, in_arrow, others, text_bytes
from spantail.llm.wavelet import WaveletMatrix

#: Words in a shard, about; a document isn't cut. Words in a segment besides the overlap. Every so many positions of a segment are sampled.
SHARD_WORDS, SEGMENT, SAMPLED = 1 << 19, 55, 8
#: Bytes of benchmark text that go to the tasks at a time.
BLOCK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts joined in raw: the words, their first and last byte (exclusive), and the n + 1 offsets of the texts in them."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _IN_WORD[raw]
    begin, begun = inside.copy(), inside[:-1]
    begin[1:] &= ~begun
    begin[at[:-1]] = inside[at[:-1]]
    final = np.zeros(len(raw) + 1, bool)
    final[1:] = begun & (~inside[1:] | begin[1:])
    first, last = np.flatnonzero(begin), np.flatnonzero(final)
    held = np.ascontiguousarray(_LOWER[raw[begun]])
    offsets = np.append(0, np.cumsum(last - first))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)])
    return words, first, last, np.searchsorted(first, at)


class FMIndex:
    """Backward search over word codes 1 and up of several documents."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, overlap: int):
        """at: the n + 1 offsets of the documents in codes; overlap: words of the longest phrase but one."""
        size = np.diff(at)
        parts = np.where(size > 0, np.maximum(1, -(-(size - overlap) // SEGMENT)), 0)
        doc = np.repeat(np.arange(len(size)), parts)
        begin = at[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        length = np.minimum(SEGMENT + overlap, at[1:][doc] - begin) + 1
        start = np.cumsum(length) - length
        self.n = int(length.sum())
        inner = np.arange(self.n) - np.repeat(start, length)
        #: The place of each position among the words; that of an end is the word after its segment.
        self.place = np.repeat(begin, length) + inner
        end = start + length - 1
        text = codes[np.minimum(self.place, len(codes) - 1)] if self.n else np.zeros(0, np.int64)
        text[end] = 0
        top = int(codes.max(initial=0)) + 1
        order = self._suffixes(text, end)
        self.matrix = WaveletMatrix.of(text[order - 1].astype(np.uint16 if top <= 1 << 16 else np.uint32), max(1, (top - 1).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        keep = (inner % SAMPLED == 0)[order]
        self.marked = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        self.sample = order[keep].astype(np.int32)

    @staticmethod
    def _suffixes(text: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Positions by their suffixes, by doubling; each end is less than all words and sorts by its position."""
        n = len(text)
        if not n:
            return np.zeros(0, np.int64)
        bits = max(1, n.bit_length())
        rank = text + len(end)
        rank[end] = np.arange(len(end))
        if 3 * bits > 63:
            raise ValueError("a shard of too many words")
        active, step, base = np.arange(n), 1, None
        while len(active):
            key = np.sort(((rank[active] << bits | rank[np.minimum(active + step, n - 1)]) << bits) | active)
            active, key = key & ((1 << bits) - 1), key >> bits
            fresh = np.append(True, key[1:] != key[:-1])
            here = np.arange(len(active))
            group = here[fresh][np.cumsum(fresh) - 1]
            if base is None:
                new = group
            else:
                old = key >> bits
                was = np.append(True, old[1:] != old[:-1])
                new = old + group - here[was][np.cumsum(was) - 1]
            rank[active], base = new, True
            alone = fresh & np.append(fresh[1:], True)
            active, step = active[~alone], 2 * step
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return order

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with the first and last (exclusive) row of each. phrases: codes from the left, 0 beyond the length."""
        live = np.arange(len(length))
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for step in range(phrases.shape[1]):
            moving = length[live] > step
            which, done = live[moving], live[~moving]
            code = phrases[which, length[which] - 1 - step]
            low[which] = self.smaller[code] + self.matrix.rank(code, low[which])
            high[which] = self.smaller[code] + self.matrix.rank(code, high[which])
            live = np.concatenate([done, which[low[which] < high[which]]])
        live.sort()
        return live, low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places among the words of rows."""
        out, todo, back = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            known = self.marked[rows + 1] > self.marked[rows]
            out[todo[known]] = self.sample[self.marked[rows[known]]] + back
            rows, todo, back = rows[~known], todo[~known], back + 1
            if len(todo):
                code, before = self.matrix.access(rows)
                rows = self.smaller[code] + before
        return self.place[out]


class Phrases:
    """The phrases of a block of items: distinct rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(names)}
        raw, at = text_bytes(pa.array([t for _, t in items], pa.string()))
        words, _, _, edge = words_of(raw, at)
        coded = words.dictionary_encode()
        flat = np.append(coded.indices.to_numpy(zero_copy_only=False), np.full(window, -1)).astype(np.int32)
        size = np.diff(edge)
        times = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        owner = np.repeat(np.arange(len(size)), times)
        begin = edge[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        length = np.minimum(window, size[owner])
        inside = np.arange(window) < length[:, None]
        rows = np.where(inside, flat[begin[:, None] + np.arange(window)], np.int32(-1))
        self.names, self.vocabulary, self.window = names, coded.dictionary, window
        #: Numbers of words, -1 beyond the phrase.
        self.words, which = np.unique(rows, axis=0, return_inverse=True)
        self.length = (self.words >= 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), np.array([number[i] for i, _ in items], np.int64)[owner]], 1), axis=0)
        self.item = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))


class Blocks:
    """The phrases of all items, block by block."""

    def __init__(self, packed: list[Broadcast]):
        self.packed, self.only = packed, None

    @staticmethod
    def pack(phrases: Phrases) -> bytes:
        return zstandard.ZstdCompressor().compress(pickle.dumps(phrases))

    def __iter__(self) -> Iterator[Phrases]:
        if self.only is not None:
            yield self.only
            return
        for b in self.packed:
            phrases = pickle.loads(zstandard.ZstdDecompressor().decompress(b.value))
            if len(self.packed) == 1:
                self.only = phrases
            yield phrases


def _occurrences(words: pa.Array, edge: np.ndarray, blocks: Blocks, window: int) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
    """Phrases, places among the words where one starts, and which; one index after the other, each over SHARD_WORDS and the overlap."""
    for a in range(0, len(words), SHARD_WORDS):
        b = min(len(words), a + SHARD_WORDS + window - 1)
        coded, index = words[a:b].dictionary_encode(), None
        for phrases in blocks:
            known = pc.index_in(phrases.vocabulary, coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            mine = np.append(known, 0)[phrases.words]
            possible = np.flatnonzero(((mine > 0) | (phrases.words < 0)).all(axis=1))
            if not len(possible):
                continue
            index = index or FMIndex(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.clip(edge, a, b) - a, window - 1)
            found, low, high = index.search(mine[possible], phrases.length[possible])
            if len(found):
                count = high - low
                yield phrases, a + index.locate(np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())), np.repeat(possible[found], count)


def _hits(texts: pa.Array, blocks: Blocks, window: int) -> tuple[np.ndarray, list, list, list]:
    """For each text: its words, the merged spans found in words and in code points, and the items found."""
    raw, at = text_bytes(texts)
    words, first, last, edge = words_of(raw, at)
    n = len(at) - 1
    spans, chars, items = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
    cover = np.zeros(len(words) + 1, np.int32)
    for phrases, place, which in _occurrences(words, edge, blocks, window):
        np.add.at(cover, place, 1)
        np.add.at(cover, place + phrases.length[which], -1)
        times = np.diff(phrases.item_at)[which]
        item = phrases.item[np.repeat(phrases.item_at[which] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        doc = np.searchsorted(edge, place, "right") - 1
        for d, i in np.unique(np.stack([np.repeat(doc, times), item], 1), axis=0).tolist():
            items[d].add(phrases.names[i])
    hit = np.cumsum(cover[:-1]) > 0
    for d in [d for d, found in enumerate(items) if found]:
        mask = np.concatenate([[0], hit[edge[d] : edge[d + 1]].astype(np.int8), [0]])
        a, b = np.flatnonzero(np.diff(mask) == 1), np.flatnonzero(np.diff(mask) == -1)
        point = np.append(0, np.cumsum((raw[at[d] : at[d + 1]] & 0xC0) != 0x80))
        spans[d] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        chars[d] = [{"start": int(point[first[edge[d] + x] - at[d]]), "end": int(point[last[edge[d] + y - 1] - at[d]])} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return np.diff(edge), spans, chars, [sorted(i) for i in items]


def contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of df (all, if None) and, for each row, n_words, spans (of words), char_spans (of code points) and items (names in order).

    A column of df under one of these names is replaced.
    """
    spark = df.sparkSession
    tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    made = ("n_words", "spans", "char_spans", "items")
    wanted = others(df.columns if keep is None else keep, *made)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("char_spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    packed = []
    for b in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else tests
        packed.append(spark.sparkContext.broadcast(Blocks.pack(Phrases([(r.item, r.text) for r in block.collect()], window))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Blocks(packed)
        for part in byte_slices(batches, 0, 6 * SHARD_WORDS):
            n_words, spans, chars, items = _hits(part.column(0), held, window)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(chars, kind), pa.array(items, pa.list_(pa.string()))],
                [*part.schema.names[1:], *made],
            )

    rows = df.select(F.col(text_col).alias("__text"), *wanted)
    return in_arrow(rows, run, T.StructType([*rows.schema.fields[1:], *fields]))


def n_hit() -> Column:
    """The words in spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
