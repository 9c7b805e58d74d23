"""Near copies: documents linked where their sets of word shingles have a Jaccard similarity of 4/5 or more.

Words and shingles are those of `simhash` (`width` words; fewer words: all of them), each shingle once,
by its XXH64. Texts of one set are one class; texts without a word are the class of the empty set.

SimHash comes first: each set's fingerprint, bits that over half its shingles' hashes have, is linked to
those of DISTANCE or fewer other bits by pigeonhole on blocks (`simhash.links`); each link is checked
exactly, on the whole sets, and those that hold are the first components. Texts at 4/5 may differ in
more bits, too many for blocks, so no answer is left to the fingerprint alone: what is still apart is
searched exactly, as follows; pairs that SimHash's links connect are not looked at again.

Candidates: in one order of all shingles, two sets this similar share a shingle among the first
n - ceil(4n/5) + 1 of each (prefix filter), and the places of the first one shared bound what they can
have in common. So no pair is lost. The order puts shingles that are common in a sample last; that
decides only how many candidates there are. Sketches, counts of a set's shingles in 256 buckets, bound
the difference of two sets from below and drop most of the rest; each pair left is verified on its
whole sets.

Each worker emits the prefix of a set once, entries are dealt by shingle (common ones by parts of
their members) and stream through a task in order, so a task holds one part of a batch. A shingle in
more than `crowded` prefixes, or in parts, first gives pairs of neighbours and of the parts' first
members. What these leave in different components is joined further by rounds in which a few members of
each component name their likeliest partner outside it, as long as that finds links. Of what is then
still apart, all pairs that pass the bounds are verified. So groups of near copies cost no pairs among
those already linked, and no link is lost.

Texts are read three times and not shuffled, as long as what meets them is counted to be small. Null
texts are empty. Of repeated rows (one id and text) any one counts; null ids come last. An empty table
gives no rows. Very long texts are a batch of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from spantail.llm.common import byte_slices, counted, drop, in_arrow, text_bytes, written
from spantail.llm.simhash import HASHED, SEED, bits_of, components
from spantail.llm.simhash import links as simhash_links

#: Rows in the sample that tells common shingles, and in how many of them these are.
SAMPLE, COMMON = 5_000, 3
#: Differing bits that link fingerprints, and the blocks that these are cut in.
DISTANCE, CUT = 2, 4
#: Neighbours that a member of a crowded prefix is paired with at first; parts of a common shingle's members.
NEIGHBOURS, PARTS = 2, 31
#: Members of a component that name a partner for each crowded shingle; the rounds end when so few, or a smaller share of them, are right.
NAMING, FEW, RIGHT = 3, 1000, 1 / 8
#: Buckets of a sketch; sets that a worker remembers to have emitted; members of a shingle held at a time.
BUCKETS, REMEMBERED, HELD = 256, 500_000, 1 << 16
#: An entry's part, the size of its set and its place in it share a long: 5, 30 and 28 bits, as a text has at most 2^30 words.
_PART, _SIZE = 58, 28


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = text_bytes(texts)
    whole, hash64 = raw.tobytes().lower(), xxhash.xxh64_intdigest
    for i in range(len(at) - 1):
        words = whole[at[i] : at[i + 1]].split()
        if len(words) <= width:
            yield np.array([hash64(b" ".join(words), SEED)] if words else [], np.uint64)
        else:
            yield np.unique(np.array([hash64(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))], np.uint64))


def _lists(sets: list[np.ndarray | None]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([0 if s is None else len(s) for s in sets])]).astype(np.int32)
    flat = [s for s in sets if s is not None]
    values = pa.array(np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(at), values, mask=pa.array([s is None for s in sets], pa.bool_()))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """The second column of rows (text, ...) and the set of the text."""
    name = rows.columns[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 0, HASHED):
            yield pa.RecordBatch.from_arrays([part.column(1), _lists(list(shingle_sets(part.column(0), width)))], [name, "hashes"])

    return in_arrow(rows, run, rows.select(name).schema.add("hashes", ArrayType(LongType())))


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Hashes found in COMMON texts or more of a sample: as the sample is bounded, so are they."""
    every = -(-rows.count() // SAMPLE) or 1
    found = _sets(rows.where(F.pmod("key", F.lit(every)) == 0).select("text", "key"), width).select(F.explode("hashes").alias("h"))
    often = found.groupBy("h").count().where(F.col("count") >= COMMON).select("h").toArrow()
    return np.sort(often.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _marked(rows: DataFrame, width: int, common: np.ndarray) -> DataFrame:
    """id, key, fp (a hash of the text's set), its size n, SimHash, sketch and prefix, and how much of that is uncommon; the prefix is null where the task has met the set before."""
    last = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = last.value, set()
        for part in byte_slices(batches, 0, HASHED):
            fps, sizes, sims, sketches, heads, rare = [], [], [], [], [], []
            for s in shingle_sets(part.column(0), width):
                n, fp = len(s), xxhash.xxh3_64_intdigest(s.tobytes())
                fps.append(fp)
                sizes.append(n)
                sims.append(bits_of(s, np.array([n]))[0])
                sketches.append(np.minimum(np.bincount(s % np.uint64(BUCKETS), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                if fp in seen:
                    heads.append(None)
                    rare.append(0)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(fp)
                often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) and n else np.zeros(n, bool)
                heads.append(np.concatenate([s[~often], s[often]])[: n - (4 * n + 4) // 5 + 1])
                rare.append(n - int(often.sum()))
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int64)), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), _lists(heads), pa.array(rare, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], ["id", "key", "fp", "n", "simhash", "sketch", "prefix", "rare"])

    return in_arrow(rows, run, rows.drop("text").schema.add("fp", "long").add("n", "long").add("simhash", "long").add("sketch", "binary").add("prefix", ArrayType(LongType())).add("rare", "long"))


def _entries(marked: DataFrame) -> DataFrame:
    """h, pack and fp of each shingle of each prefix."""
    one = marked.select("fp", "n", "rare", F.posexplode("prefix").alias("at", "h"))
    part = F.when(F.col("at") >= F.col("rare"), 1 + F.pmod("fp", F.lit(PARTS - 1))).otherwise(F.lit(0)).cast("long")
    return one.select("h", (F.shiftleft(part, _PART) + F.shiftleft("n", _SIZE) + F.col("at")).alias("pack"), "fp")


def _unpacked(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and places."""
    return (pack >> _SIZE) & ((1 << (_PART - _SIZE)) - 1), pack & ((1 << _SIZE) - 1)


def _possible(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sizes, and the places of a shingle as the first one shared, allow the similarity."""
    most = 1 + np.minimum(n[i] - 1 - at[i], n[j] - 1 - at[j])
    return 9 * most >= 4 * (n[i] + n[j])


def _runs(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """Distinct entries in order of shingle (and part), by whole runs or, with parts, pieces of a long one: rows of h, pack, fp, ...; run numbers; whether the first run goes on from before, and the last one further."""
    held, going = None, False
    for batch in batches:
        now = np.concatenate([_longs(c) for c in batch.columns])
        held = now if held is None else np.concatenate([held, now], axis=1)
        if not held.shape[1]:
            continue
        held = held[:, np.append(True, (held[:, 1:] != held[:, :-1]).any(axis=0))]  # a set that several tasks emitted
        run = _numbers(held, parts)
        end = int(np.searchsorted(run, run[-1]))
        if end:
            yield held[:, :end], run[:end], going, False
            held, going = held[:, end:], False
        elif held.shape[1] > HELD and parts:
            yield held, run, going, True
            held, going = held[:, -NEIGHBOURS:], True
    if held is not None and held.shape[1]:
        yield held, _numbers(held, parts), going, False


def _longs(column: pa.Array) -> np.ndarray:
    """A column as one row of longs, or sketches as several."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, BUCKETS // 8).T
    return column.to_numpy(zero_copy_only=False)[None]


def _numbers(rows: np.ndarray, parts: bool) -> np.ndarray:
    new = rows[0, 1:] != rows[0, :-1]
    if parts:
        new |= rows[1, 1:] >> _PART != rows[1, :-1] >> _PART
    return np.append(0, np.cumsum(new))


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.nulls(len(u), pa.int64())], ["u", "v", "h"])


def _met(entries: DataFrame, crowded: int) -> DataFrame:
    """u, v and h: pairs u < v without h, and the entries (fp, pack, h) of crowded shingles and of those in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, run, going, on in _runs(batches, True):
            size = np.bincount(run)[run]
            full = size > crowded
            if going or on:
                full |= run == run[0 if going else -1]
            kept = full | (rows[1] >> _PART > 0)
            kept[: NEIGHBOURS if going else 0] = False  # they came before
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[2, kept]), pa.array(rows[1, kept]), pa.array(rows[0, kept])], ["u", "v", "h"])
            some = size > 1
            rows, run, full = rows[:, some], run[some], full[some]
            n, at = _unpacked(rows[1])
            for lag in range(1, max(crowded, NEIGHBOURS + 1)):
                i = np.flatnonzero(run[:-lag] == run[lag:]) if lag < len(run) else np.zeros(0, np.int64)
                if not len(i):
                    break
                if lag > NEIGHBOURS:
                    i = i[~full[i]]
                i = i[_possible(n, at, i, i + lag)]
                if len(i):
                    yield _pairs(rows[2, i], rows[2, i + lag])

    # neighbours are the same for many shingles of a group, as their order hangs on the sets alone
    dealt = entries.repartition("h", F.shiftright("pack", _PART)).sortWithinPartitions("h", F.shiftright("pack", _SIZE), "fp")
    return in_arrow(dealt, run, "u long, v long, h long")


def _apart(entries: DataFrame, naming: int = 0) -> DataFrame:
    """u, v: pairs of a shingle's entries (h, pack, fp, own, sketch) whose components differ and whose sizes, places and sketches allow it.

    All of them, or only the likeliest partner of each of `naming` members of a component, others for each shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, run, _, _ in _runs(batches, False):
            edge = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            for a, b in zip(edge, [*edge[1:], rows.shape[1]], strict=True):
                here = rows[:, a:b]
                if naming:
                    order = np.lexsort((_mixed(here[2].copy(), here[0].copy()), here[3]))
                    own = here[3, order]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    rank = np.arange(b - a) - np.repeat(first, np.diff(np.append(first, b - a)))
                    here = here[:, order[rank < naming]]
                _, pack, fp, own = here[:4]
                sketch = np.ascontiguousarray(here[4:].T).view(np.uint8).astype(np.int16)
                n, at = _unpacked(pack)
                _, group, count = np.unique(own, return_inverse=True, return_counts=True)
                big, place = group == np.argmax(count), np.arange(len(own))
                for i in place if naming else np.flatnonzero(~big):  # the largest component is met by all others
                    j = np.flatnonzero((own != own[i]) & (4 * n <= 5 * n[i]) & (4 * n[i] <= 5 * n) & (big | (place > i) | (naming > 0)))
                    j = j[_possible(n, at, np.full(len(j), i), j)]
                    apart = np.abs(sketch[j] - sketch[i]).sum(axis=-1, dtype=np.int64)
                    fit = 9 * apart <= n[j] + n[i]
                    j, apart = j[fit], apart[fit]
                    if len(j) and naming:
                        j = j[[np.argmin(apart)]]
                    if len(j):
                        yield _pairs(np.full(len(j), fp[i]), fp[j])

    dealt = entries.select("h", "pack", "fp", "own", "sketch").repartition("h").sortWithinPartitions("h", "pack", "fp")
    return in_arrow(dealt, run, "u long, v long, h long").select("u", "v").distinct()


def _mixed(fp: np.ndarray, h: np.ndarray) -> np.ndarray:
    """An order of sets that is another one for each shingle."""
    return (fp.view(np.uint64) ^ h.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def _alike(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sketches leave the similarity possible: their difference is at most that of the sets, which is at most a ninth of both sizes."""
    return 9 * np.abs(a - b).sum(axis=-1, dtype=np.int64) <= sizes


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sketches leave the similarity possible."""
    of = lambda c: classes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "nu", "nv", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (4, 5))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(_alike(a, b, n)))

    return in_arrow(both, run, "u long, v long")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """A written table of the pairs whose whole sets have 4/5 of their union in common."""
    near, near_path = written(_sketched(pairs, classes), "near")
    asked = near.select(F.col("u").alias("fp")).unionAll(near.select(F.col("v").alias("fp"))).distinct()
    asked, asked_path = written(asked.join(classes, "fp").select("fp", F.col("first.id").alias("id"), F.col("first.key").alias("key")), "asked")
    here = counted(asked.withColumnsRenamed({"id": "__id", "key": "__key"}))
    texts = rows.join(here, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id"))).select("text", "fp")
    sets, sets_path = written(_sets(texts, width).groupBy("fp").agg(F.first("hashes").alias("hashes")), "sets")
    both = near.join(sets.select(F.col("fp").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ao, bo, av, bv = a.offsets.to_numpy(), b.offsets.to_numpy(), a.values.to_numpy(), b.values.to_numpy()
            keep = []
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    out, _ = written(in_arrow(both, run, "u long, v long"), "verified")
    for path in (near_path, asked_path, sets_path):
        drop(rows.sparkSession, path)
    return out


def _near_fingerprints(classes: DataFrame) -> DataFrame:
    """u, v: pairs of classes by the SimHash links of their fingerprints; classes of one fingerprint are paired with its least."""
    first = classes.groupBy("simhash").agg(F.min("fp").alias("least"))
    first, _ = written(first, "fingerprints")
    same = classes.join(first, "simhash").where("fp > least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    near = simhash_links(first.select(F.col("simhash").alias("fp")), DISTANCE, CUT)
    of = lambda c: first.select(F.col("simhash").alias(c), F.col("least").alias(f"of_{c}"))
    other = near.join(of("u"), "u").join(of("v"), "v")
    return same.unionAll(other.select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v")))


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) whose components by the links found differ."""
    reached, _ = written(components(found), "reached")
    of = lambda c: counted(reached.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}")))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.where(F.coalesce("least_u", "u") != F.coalesce("least_v", "v")).select(*pairs.columns)


def links(marked: DataFrame, classes: DataFrame, rows: DataFrame, width: int, crowded: int) -> DataFrame:
    """Pairs of classes that connect whatever is similar: by SimHash, and what it leaves apart by prefixes."""
    close, close_path = written(_near_fingerprints(classes), "close")
    found = _verified(close, classes, rows, width)
    met, path = written(_met(_entries(marked), crowded), "met")
    many = met.where("h is not null").select("h", F.col("v").alias("pack"), F.col("u").alias("fp"))
    part = F.shiftright("pack", _PART)
    bare = many.withColumn("part", part).withColumn("pack", F.col("pack") - F.shiftleft(part, _PART))
    first_of = F.min(F.struct(F.shiftright("pack", _SIZE).alias("n"), "fp", "pack"))
    heads = bare.where("part > 0").groupBy("h", "part").agg(first_of.alias("one")).select("h", "one.pack", "one.fp")
    ahead = _met(heads, PARTS + 1).select("u", "v")
    pairs = met.where("h is null").select("u", "v").unionAll(ahead).distinct()
    more, more_path = written(_across(pairs, found).join(close, ["u", "v"], "left_anti"), "tried")
    found, tried, tries = found.unionAll(_verified(more, classes, rows, width)), more.unionAll(close), [close_path, more_path]

    def still_apart(naming: int) -> DataFrame:
        """A written table of pairs across components that weren't tried."""
        reached = components(found).select(F.col("node").alias("fp"), "least")
        known = bare.join(reached, "fp", "left").select("h", "pack", "fp", F.coalesce("least", "fp").alias("own"))
        split = known.groupBy("h").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("h")
        members = known.join(split, "h", "left_semi").join(classes.select("fp", "sketch"), "fp")
        pairs, path = written(_apart(members, naming).join(tried, ["u", "v"], "left_anti"), "tried")
        tries.append(path)
        return pairs

    while True:
        named = still_apart(NAMING)
        right = _verified(named, classes, rows, width)
        found, tried = found.unionAll(right), tried.unionAll(named)
        if right.count() <= max(FEW, RIGHT * named.count()):
            break
    found = found.unionAll(_verified(still_apart(0), classes, rows, width))
    for p in (path, *tries):
        drop(rows.sparkSession, p)
    return found


def _same(row: Column, other: str) -> Column:
    return (F.col(f"{other}.key") == row["key"]) & F.col(f"{other}.id").eqNullSafe(row["id"])


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, crowded: int = 32) -> DataFrame:
    """The rows of df, one of each component of links: that of the smallest id, of repeated rows any one."""
    key = F.xxhash64(F.coalesce(text_col, F.lit("")))
    rows = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), key.alias("key"))
    marked, marked_path = written(_marked(rows, width, common_shingles(rows, width)), "marked")
    number = F.struct(F.col("id").isNull().alias("null"), "id", "key")
    classes, classes_path = written(marked.groupBy("fp").agg(F.min(number).alias("first"), F.first("n").alias("n"), F.first("simhash").alias("simhash"), F.first("sketch").alias("sketch")), "classes")
    reached = components(links(marked, classes, rows, width, crowded)).select(F.col("node").alias("fp"), "least")
    named = classes.select("fp", "first").join(reached, "fp", "left").withColumn("least", F.coalesce("least", "fp"))
    chosen = named.groupBy("least").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"), F.col("first.key").alias("key"), F.lit(True).alias("chosen"))
    held = marked.groupBy("id", "key").count()
    judged = held.alias("held").join(chosen.alias("chosen"), (F.col("held.key") == F.col("chosen.key")) & F.col("held.id").eqNullSafe(F.col("chosen.id")), "left").select("held.id", "held.key", "count", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    gone, _ = written(judged.where("not chosen or count > 1"), "gone")
    for path in (marked_path, classes_path):
        drop(df.sparkSession, path)
    whole = df.withColumns({"__id": F.col(id_col), "__key": key})
    this = F.struct(F.col("__id").alias("id"), F.col("__key").alias("key"))
    out = whole.join(counted(gone.select("id", "key")).alias("gone"), _same(this, "gone"), "left_anti")
    again = gone.where("chosen").select("id", "key")
    if again.head(1):
        repeated = whole.join(counted(again).alias("again"), _same(this, "again"), "left_semi")
        out = out.unionAll(repeated.dropDuplicates(["__id", "__key"]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
