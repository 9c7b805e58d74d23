"""Token ids in wavelet matrices: one compressed file image per shard, with access, rank and select.

A shard holds the ids of consecutive documents. Ids become codes by falling frequency, so that the
high bit-planes are nearly empty and compress well. Plane l holds bit l (from the top) of every code,
in the order that the planes above it leave: zeros first, then ones. Counts of ones at every 64 bits
give rank in constant time; select descends the planes and climbs back by binary search in the
counts. From one image: the id at a place, how often an id occurs before a place, and its k-th place.

File image, little-endian: magic, version, number of ids, documents, codes and planes, first place;
then the zstd-compressed table of codes with their numbers of occurrences, document ids and lengths,
and planes, each with its length. The counts of ones are made when rank or select first asks; reading
all ids needs none: below the last plane equal codes stand together, as many as the table says.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantail.llm.common import byte_slices, in_arrow, written
from spantail.llm.tokens import Encoder, described

MAGIC, VERSION = b"WMAT", 2
_HEAD = struct.Struct("<4sIQQQIq")
#: Ids in a shard, about; a shard ends with a document.
SHARD_IDS = 1 << 20


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with a spare word at the end."""
    raw = np.packbits(bits, bitorder="little")
    return np.pad(raw, (0, 16 - len(raw) % 8)).view("<u8")


def _split(values: pa.Array, words: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The values whose bit is unset, and those whose bit is set, in order."""
    mask = pa.Array.from_buffers(pa.bool_(), len(values), [None, pa.py_buffer(words)])
    return values.filter(pc.invert(mask)), values.filter(mask)


class WaveletMatrix:
    """Codes 0 to 2**levels - 1 as bit-planes with rank support; all methods take arrays."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)

    @cached_property
    def before(self) -> list[np.ndarray]:
        """Ones before each word of each plane."""
        return [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)[:-1]]) for p in self.planes]

    @cached_property
    def zeros(self) -> list[int]:
        return [self.n - int(np.bitwise_count(p).sum(dtype=np.int64)) for p in self.planes]

    @classmethod
    def of(cls, codes: np.ndarray, levels: int) -> WaveletMatrix:
        planes, now = [], pa.array(codes)
        for level in range(levels):
            words = _packed(now.to_numpy(zero_copy_only=False) & codes.dtype.type(1 << (levels - 1 - level)) != 0)
            planes.append(words)
            now = pa.concat_arrays(_split(now, words))
        return cls(planes, len(codes))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.planes[level][word] & below)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def _down(self, level: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = self._ones(level, at)
        return np.where(bit, self.zeros[level] + ones, at - ones)

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes at some places, and how often each occurs before its place."""
        code, at = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for level in range(self.levels):
            bit = self._bit(level, at).astype(bool)
            at = self._down(level, at, bit)
            code = 2 * code + bit
        return code, at - self.first(code)

    def first(self, code: np.ndarray) -> np.ndarray:
        """Where the codes' block starts below the last plane."""
        return self._descend(code, np.zeros(len(code), np.int64))

    def _descend(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            at = self._down(level, at, (code >> (self.levels - 1 - level)) & 1 == 1)
        return at

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code occurs before its place."""
        return self._descend(code, np.asarray(at, np.int64)) - self.first(code)

    def select(self, code: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0) occurrences of one code."""
        at = self.first(np.array([code]))[0] + np.asarray(k, np.int64)
        for level in reversed(range(self.levels)):
            bit = (code >> (self.levels - 1 - level)) & 1
            at = self._place(level, at - self.zeros[level] if bit else at, bit)
        return at

    def _place(self, level: int, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th bit of that value in a plane."""
        counts = self.before[level] if bit else np.arange(len(self.before[level])) * 64 - self.before[level]
        word = np.searchsorted(counts, k, "right") - 1
        left = k - counts[word]
        bits = np.unpackbits(self.planes[level][word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        return word * 64 + np.argmax(np.cumsum(bits, axis=1) > left[:, None], axis=1)

    def spread(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """values[c] at each place of each code c, of which there are counts[c]."""
        order = pa.array(np.arange(self.n, dtype=np.uint32))
        for words in self.planes:
            order = pa.concat_arrays(_split(order, words))
        last = np.argsort(_mirrored(np.arange(len(counts)), self.levels))
        out = np.empty(self.n, values.dtype)
        out[order.to_numpy(zero_copy_only=False)] = np.repeat(values[last], counts[last])
        return out


def _mirrored(codes: np.ndarray, levels: int) -> np.ndarray:
    """Codes with their bits in reverse: in this order they stand below the last plane."""
    out = np.zeros_like(codes)
    for level in range(levels):
        out = 2 * out + ((codes >> level) & 1)
    return out


class Shard:
    """The ids of consecutive documents, readable from one file image."""

    def __init__(self, matrix: WaveletMatrix, alphabet: np.ndarray, counts: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray, start: int):
        self.matrix, self.alphabet, self.counts, self.doc_ids, self.lengths, self.start = matrix, alphabet, counts, doc_ids, lengths, start

    @cached_property
    def code(self) -> dict[int, int]:
        return {int(x): c for c, x in enumerate(self.alphabet)}

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray, start: int = 0) -> Shard:
        seen = np.bincount(ids, minlength=1)
        alphabet = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)].astype(np.uint32)
        code = np.zeros(len(seen), np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        small = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        return cls(WaveletMatrix.of(code[ids].astype(small), max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 1), alphabet, seen[alphabet], doc_ids, lengths, start)

    def ids(self) -> np.ndarray:
        """All ids in order."""
        return self.matrix.spread(self.alphabet, self.counts)

    def token(self, at: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        return self.alphabet[self.matrix.access(at)[0]]

    def count(self, token: int, begin: int, end: int) -> int:
        """How often an id occurs from begin to end, end exclusive."""
        if token not in self.code:
            return 0
        a, b = self.matrix.rank(np.full(2, self.code[token]), np.array([begin, end]))
        return int(b - a)

    def find(self, token: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0) occurrences of an id."""
        return self.matrix.select(self.code[token], k)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        known = np.array([x is not None for x in self.doc_ids.to_pylist()], np.uint8)
        numbers = self.doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        parts = [self.alphabet.astype("<u4").tobytes() + self.counts.astype("<u4").tobytes(), known.tobytes() + numbers.tobytes() + self.lengths.astype("<i8").tobytes(), *(p.tobytes() for p in self.matrix.planes)]
        image = [_HEAD.pack(MAGIC, VERSION, self.matrix.n, len(self.lengths), len(self.alphabet), self.matrix.levels, self.start)]
        for part in map(pack, parts):
            image += [struct.pack("<Q", len(part)), part]
        return b"".join(image)

    @classmethod
    def from_bytes(cls, image: bytes) -> Shard:
        magic, version, n, docs, codes, levels, start = _HEAD.unpack_from(image)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a wavelet matrix file of this version")
        at, parts, unpack = _HEAD.size, [], zstandard.ZstdDecompressor().decompress
        while at < len(image):
            (size,) = struct.unpack_from("<Q", image, at)
            parts.append(unpack(image[at + 8 : at + 8 + size]))
            at += 8 + size
        known = np.frombuffer(parts[1][:docs], np.uint8) == 1
        numbers = np.frombuffer(parts[1][docs : 9 * docs], "<i8")
        planes = [np.frombuffer(p, "<u8") for p in parts[2 : 2 + levels]]
        return cls(WaveletMatrix(planes, n), *np.split(np.frombuffer(parts[0], "<u4"), [codes]), pa.array(numbers, mask=~known), np.frombuffer(parts[1][9 * docs :], "<i8"), start)


def write_token_files(df: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """A written table of file images: part, start (ids before it in its part), n_ids and image.

    Rows are dealt to parts by ranges of doc_id, then of a hash of the text, and sorted, so parts, and
    images in a part, are in ascending doc_id order, and rows of one id, or without one, may be of many
    parts. Each document is its ids and `end_id`. Null texts are empty, null ids come first, rows of one
    id are in order of that hash. Texts of any length are split where no token can cross. An empty table
    gives no image.
    """
    spark = df.sparkSession
    told = described(spark, tokenizer_path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, part = Encoder.of(told.value), 0, 0
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

        def image() -> pa.RecordBatch:
            nonlocal start
            ids = np.concatenate([h[0] for h in held])
            shard = Shard.of(ids, pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]), start)
            held.clear()
            start += len(ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard.start]), pa.array([len(ids)]), pa.array([shard.to_bytes()], pa.binary())], ["part", "start", "n_ids", "image"])

        for rows in byte_slices(batches, 1):
            ids, at = encoder.encode(rows.column(1))
            part, size = rows.column(2)[0].as_py(), np.diff(at)
            held.append((np.insert(ids, at[1:], np.uint32(end_id)), rows.column(0), size + 1))
            if sum(len(h[0]) for h in held) >= shard_ids:
                yield image()
        if held:
            yield image()

    images = in_arrow(rows, run, "part int, start long, n_ids long, image binary", encodes=True)
    return written(images, "wavelet", compression="uncompressed")[0]


def read_token_files(images: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from file images.

    What is gathered first is one number for each part of the table.
    """
    parts = sorted(images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, base = {}, 0
    for part, n in parts:
        before[part], base = base, base + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, image in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard.from_bytes(image.as_py())
                raw, size = shard.ids().astype("<u4").tobytes(), shard.lengths
                end = np.cumsum(size)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(end - size, end, strict=True)]
                yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(before[part.as_py()] + shard.start + end - size), pa.array(size.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_arrow(images.select("part", "image"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
