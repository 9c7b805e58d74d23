"""SimHash near-duplicates: word-shingle fingerprints, pigeonhole blocks, linked components.

Fingerprint: A-Z is lower-cased, words are runs of anything but ASCII white space, shingles are
`width` consecutive words joined by a space, repeats included (fewer words: all of them; none, or
null: fingerprint zero). A bit is set if it is set in over half the shingles' XXH64 (seed 42).

Links: equal fingerprints are one class, found by a grouped minimum, so copies cost no pairs. Two
fingerprints within `distance` bits agree in at least blocks - distance of `blocks` equal blocks:
each combination of that many blocks is a join key; the Hamming distance is verified on each pair.
A key that more than `crowded` fingerprints share isn't joined. There each fingerprint is written
with every way to flip up to half the distance, rounded up, of its remaining bits, those of up to half
the distance, rounded down, being inner ones: two of them are within the distance exactly if an inner
variant of one is a variant of the other, and what meets in a variant is linked to its least inner
one. So no link is lost and none is false, whatever the size of a group, without its pairs.

Components: rounds of large-star and small-star over distinct linked fingerprints, each round a table
in the shared folder; nothing but counts comes to the driver. Fingerprints of very many rows, and nodes
of very many edges, meet their component by broadcast.

Null texts are empty. Repeated rows each get their row. Null ids keep their row, and count for no
component's smallest id. Very long texts are hashed whole, a bounded number of shingles' bits at a time.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantail.llm.common import FEW_ROWS, byte_slices, drop, in_arrow, joined_hot, others, text_bytes, written

SEED = 42
#: Text bytes that are hashed at a time: their hashes' bits take 64 bytes a word.
HASHED = 1 << 20


def fingerprint_batch(texts: pa.Array, width: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of an Arrow text array."""
    raw, at = text_bytes(texts)
    whole, hash64 = raw.tobytes().lower(), xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(at) - 1, np.int64)
    for i in range(len(counts)):
        words = whole[at[i] : at[i + 1]].split()
        if not words:
            continue
        if len(words) <= width:
            hashes.append(hash64(b" ".join(words), SEED))
            counts[i] = 1
        else:
            hashes.extend([hash64(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))])
            counts[i] = len(words) - width + 1
    return bits_of(np.array(hashes, np.uint64), counts)


def bits_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprints of texts with so many hashes each, in order: bits that over half of them have."""
    if not len(hashes):
        return np.zeros(len(counts), np.uint64)
    bits = (2 * _ones(hashes, counts) > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _ones(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many hashes of each text have each bit set."""
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros((len(counts), 64), np.int64)
    step = HASHED // 8
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i : i + step]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return total


def fingerprints(df: DataFrame, text_col: str = "text", width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all, if None) and fp, the fingerprint as a signed long; a column of that name is replaced."""
    kept = others(df.columns if keep is None else keep, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 0, HASHED):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fingerprint_batch(part.column(0), width).view(np.int64))], [*kept, "fp"])

    rows = df.select(F.col(text_col).alias("__text"), *kept)
    return in_arrow(rows, run, rows.drop("__text").schema.add("fp", "long"))


def _masks(blocks: int, distance: int) -> list[int]:
    """The bits of each combination of blocks that two close fingerprints may share."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, distance: int) -> list[int]:
    """Every way to flip up to `distance` of the bits outside a mask."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(c) for k in range(distance + 1) for c in combinations(free, k)]


def links(classes: DataFrame, distance: int = 2, blocks: int = 4, crowded: int = 64) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints in column fp that connect whatever is within the distance (at most 3)."""
    if not 0 < distance <= 3 or not distance < blocks <= 8:
        raise ValueError("distances of 1 to 3, and more blocks than that, but at most 8")
    masks = _masks(blocks, distance)
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("way", "key"))
    full = keyed.groupBy("way", "key").count().where(F.col("count") > crowded).select("way", "key")
    full, _ = written(full, "crowded")
    thin = keyed.join(full, ["way", "key"], "left_anti")
    a, b = thin.select("way", "key", F.col("fp").alias("u")), thin.select("way", "key", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    pairs = a.join(b, ["way", "key"]).where(near).select("u", "v")
    outer, inner = (distance + 1) // 2, distance // 2
    flips = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)) for x in _flips(m, outer)]) for m in masks]), F.col("way") + 1)
    flipped = keyed.join(full, ["way", "key"], "left_semi").withColumn("flip", F.explode(flips))
    met = flipped.groupBy("way", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")).agg(F.collect_set("fp").alias("met"), F.min(F.when(F.bit_count("flip") <= inner, F.col("fp"))).alias("hub"))
    stars = met.where((F.size("met") > 1) & F.col("hub").isNotNull()).select("hub", F.explode("met").alias("other")).where("hub <> other")
    return pairs.unionAll(stars.select(F.least("hub", "other").alias("u"), F.greatest("hub", "other").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Each node of the edges (u, v) with `least`, the smallest node it can reach."""
    spark = edges.sparkSession
    now, path = written(edges.select("u", "v").where("u <> v"), "edges")
    state, size = None, now.count()
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), None
        if 2 * size > FEW_ROWS:
            low, low_path = written(low, "low")
            large = joined_hot(both.where("v > u"), low, "u")
        else:
            large = both.where("v > u").join(low.drop("n"), "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.join(floor, "u")
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(floor.select("u", F.col("m").alias("v"))).distinct()
        nxt, nxt_path = written(small, "edges")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for p in filter(None, (path, low_path)):
            drop(spark, p)
        now, path, size = nxt, nxt_path, seen[0]
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least"))
        state = seen


def class_components(marked: DataFrame, id_col: str, distance: int = 2, blocks: int = 4, crowded: int = 64) -> DataFrame:
    """fp, n (rows) and component_id for each distinct fingerprint of a table: the smallest id reachable over links."""
    classes, _ = written(marked.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("first_id"), F.count("*").alias("n")), "classes")
    reached = components(links(classes.select("fp"), distance, blocks, crowded)).withColumnRenamed("node", "fp")
    named = classes.join(reached, "fp", "left").withColumn("least", F.coalesce("least", "fp"))
    first = named.groupBy("least").agg(F.min("first_id").alias("component_id"))
    return written(named.join(first, "least").select("fp", "least", "component_id", "n"), "components")[0]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, blocks: int = 4, crowded: int = 64) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links, for each row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked, _ = written(fingerprints(rows, "text", width, ["doc_id"]), "fingerprints")
    return joined_hot(marked, class_components(marked, "doc_id", distance, blocks, crowded), "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, blocks: int = 4, crowded: int = 64) -> DataFrame:
    """The rows of df, one of each component: that of the smallest id, of repeated rows any one.

    The rows are written with their fingerprint and a row number, so the choice is made on narrow
    columns, and the texts move once, to meet the chosen numbers.
    """
    marked, _ = written(fingerprints(df, text_col, width).withColumn("__row", F.monotonically_increasing_id()), "marked")
    reached = class_components(marked, id_col, distance, blocks, crowded)
    number = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    in_class = marked.groupBy("fp").agg(F.min(number).alias("first")).join(reached, "fp")
    chosen = in_class.groupBy("least").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    return marked.join(chosen, "__row", "left_semi").select(*df.columns)


def fingerprint_text(fp: str = "fp"):
    """The 16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
