"""Token counts and ids by the tokenizers library, in Arrow batches.

A text is split where no token can cross: before a run of ASCII white space that follows something
else, and between an ASCII letter and one of `.,;:!?`. Equal pieces of a batch are encoded once, and
each worker remembers a bounded number of pieces. The ids of a text are those of its pieces, one
after the other, and equal what the library gives for the whole text: the pre-tokenizers cut there,
neither Unicode composition nor lower-casing reaches over these characters, and no special token
holds such a place. Before white space of other kinds no split is made, as `\\s+(?!\\S)` may join the
two. Pieces that are one word of Latin letters skip the library's own search for words, as it would
find just that word. A tokenizer file of another build than the two known ones gets whole texts.

Null texts are empty. Repeated rows each get their row; null ids stay null. Long texts need no
treatment of their own: they are split like any other.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantail.llm.common import byte_slices, in_arrow, text_bytes

#: Pieces that a worker remembers, and the bytes of the longest of them; beyond, only those stay that came in most batches.
REMEMBERED, LONGEST = 700_000, 64
#: Pieces that the library encodes in one call.
CALL = 8192
#: One word of letters that every Unicode version takes for letters, composed, and lower-cased one by one.
_WORD = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Last bytes of white space other than those four (or of characters that some Unicode version took for it).
_OTHER = np.zeros(256, bool)
_OTHER[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEAD3, _MID3 = np.zeros(256, bool), np.zeros(256, bool)
_LEAD3[[0xE1, 0xE2, 0xE3, 0xEF]] = True
_MID3[[0x9A, 0xA0, 0x80, 0x81, 0xBB]] = True
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP[[ord(x) for x in ".,;:!?"]] = True


def build_of(described: str) -> str:
    """byte: byte-level words with their space; word: composed, lower-cased words without space; whole: any other."""
    file = json.loads(described)
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"[\s.,;:!?]", t["content"]) for t in file["added_tokens"]):
        return "whole"
    first, norm = file["pre_tokenizer"] or {}, file["normalizer"]
    if norm is None and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        return "byte"
    inner = first.get("pretokenizers", [])
    if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in inner] == ["Split", "ByteLevel"] and inner[0]["behavior"] == "Removed" and inner[0]["invert"] and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in inner[0]["pattern"].get("Regex", "") and not inner[1]["use_regex"]:
        return "word"
    return "whole"


def piece_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start in the joined bytes: at texts that aren't empty and at safe white space."""
    if not len(raw):
        return np.zeros(0, np.int64)
    space = _SPACE[raw]
    start = np.zeros(len(raw), bool)
    cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    one, two, three = raw[cut - 1], raw[np.maximum(cut - 2, 0)], raw[np.maximum(cut - 3, 0)]
    unsafe = _OTHER[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (_LEAD3[three] & _MID3[two])
    start[cut[~unsafe]] = True
    start[1:] |= _STOP[raw[1:]] & _LETTER[raw[:-1]]
    start[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of text batches; holds one tokenizer and the pieces met so far."""

    _held: dict[str, Encoder] = {}

    def __init__(self, described: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.build = build_of(described)
        self.tokenizer, self.words = Tokenizer.from_str(described), Tokenizer.from_str(described)
        for t in (self.tokenizer, self.words):
            t.no_padding()
            t.no_truncation()
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear()

    @classmethod
    def of(cls, described: str) -> Encoder:
        """The one of this worker for that tokenizer file."""
        key = hashlib.sha256(described.encode()).hexdigest()
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(described)
        return cls._held[key]

    @classmethod
    def forget(cls) -> None:
        """Frees the worker's memory for other work."""
        cls._held.clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.length = np.zeros(1 << 12, np.int32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.met = np.zeros(1 << 12, np.int32)
        self.used = self.filled = 0

    def _forget(self) -> None:
        """Of the pieces met in two batches or more since the last time those met most often stay, half of all at most."""
        often = np.append(np.bincount(self.met[: self.used], minlength=3)[::-1].cumsum()[::-1], 0)
        least = max(2, int(np.argmax(often <= REMEMBERED // 2)))
        kept = [(p, s) for p, s in self.slot.items() if self.met[s] >= least]
        old, length, begin, ids = np.array([s for _, s in kept], np.int64), self.length, self.begin, self.ids
        self._clear()
        if kept:
            sizes = length[old]
            flat = ids[np.repeat(begin[old] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            self._store([p for p, _ in kept], sizes, flat)

    def _library(self, texts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids. plain: each text is one word."""
        if plain:
            words = [t.strip(" ").lower() for t in texts] if self.build == "word" else texts
            e = self.words.encode(words, is_pretokenized=True, add_special_tokens=False)
            return np.bincount(np.array(e.word_ids, np.int64), minlength=len(texts)), np.array(e.ids, np.uint32)
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(chain.from_iterable(got), np.uint32)

    def _add(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), CALL):
            texts = [p.decode() for p in pieces[i : i + CALL]]
            simple = [self.build != "whole" and len(t) <= LONGEST and bool(_WORD.fullmatch(t)) for t in texts]
            for plain in (True, False):
                which = [j for j, x in enumerate(simple) if x == plain]
                if which:
                    self._store([pieces[i + j] for j in which], *self._library([texts[j] for j in which], plain))

    def _store(self, pieces: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> None:
        n, m = self.used + len(pieces), self.filled + len(flat)
        while n > len(self.length):
            self.length, self.begin, self.met = (np.resize(x, 2 * len(x)) for x in (self.length, self.begin, self.met))
        while m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.length[self.used : n] = sizes
        self.begin[self.used : n] = self.filled + np.cumsum(sizes) - sizes
        self.ids[self.filled : m] = flat
        self.met[self.used : n] = 0
        self.slot.update(zip(pieces, range(self.used, n), strict=True))
        self.used, self.filled = n, m

    def _slots(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.append(starts, len(raw)).astype(np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = held.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if self.used > REMEMBERED or self.filled > 16 * REMEMBERED:
            self._forget()
        slots = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        absent = np.flatnonzero(slots < 0)
        if len(absent):
            missing = [pieces[i] for i in absent.tolist()]
            self._add(missing)
            slots[absent] = np.fromiter(map(self.slot.__getitem__, missing), np.int64, len(missing))
            for p in missing:
                if len(p) > LONGEST:
                    del self.slot[p]
        self.met[slots] += 1
        return slots[coded.indices.to_numpy(zero_copy_only=False)]

    def _starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at[:-1][np.diff(at) > 0] if self.build == "whole" else piece_starts(raw, at)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        raw, at = text_bytes(texts)
        starts = self._starts(raw, at)
        if not len(starts):
            return np.zeros(len(at) - 1, np.int64)
        slots = self._slots(raw, starts)
        total = np.append(0, np.cumsum(self.length[slots], dtype=np.int64))
        return np.diff(total[np.searchsorted(starts, at)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n + 1 offsets of the texts in them."""
        raw, at = text_bytes(texts)
        starts = self._starts(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        slots = self._slots(raw, starts)
        sizes = self.length[slots]
        total = np.append(0, np.cumsum(sizes, dtype=np.int64))
        ids = self.ids[np.repeat(self.begin[slots] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, at)]


def described(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file for the executors: one file of a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) for each row of df.

    Texts go to the workers in Arrow batches, are cut into slices of equal bytes and leave as
    lengths only. No shuffle. Null texts have 0 bytes and 0 tokens; an empty table gives no rows.
    """
    told = described(df.sparkSession, tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(told.value)
        for part in byte_slices(batches, 1):
            _, at = text_bytes(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(encoder.counts(part.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(rows, count, "doc_id long, n_bytes long, n_tokens long", encodes=True).withColumn("over_limit", F.col("n_tokens") > max_tokens)
