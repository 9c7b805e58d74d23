"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each dimension of a shard of candidates has two sorted lists, from its largest and from its smallest
value; a query reads the first where its component is positive, else the second. All queries of a
block read their lists to the same depth, level by level. What was read so far bounds the score of
each candidate: an unread component lies between the list's end and the last value read. As these
limits belong to the list and not to the query, lower and upper bounds of a whole block come from
matrix products. A candidate is out once its upper bound is below the k-th best score that the task
has found in the shards before, or the k-th lower bound of this one. A query stops when few are left
in; their final scores are resolved and merged into its running k best. At the full depth both bounds
are the score. Levels at which next to no query stopped in the shard before aren't tried again.

Queries are one stated set in blocks of bounded size. A block comes to the driver, goes to the
candidates' tasks, and its finds are written before the next one comes; k rows of a query leave a
task. Scores are exact: products use floats only while every sum stays below what they hold exactly,
else integers.

Rows with a null id or a vector that is null or holds null, NaN or infinite components take no part.
Rows of one id count as the query's own row; of several vectors under one query id the least is
asked. Candidates of another length than the query's vector take no part in its search. Repeated
candidate rows are separate candidates; ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantail.llm.common import in_arrow, new_path

#: Shares of a sorted list read level by level; the last is all of it.
DEPTHS = (0.3, 0.6, 0.8, 0.9, 0.95, 1.0)
#: A query stops when k times this, or this share of the shard, are left in; a level is skipped if a smaller share of the queries stopped at it.
FEW, FEW_OF_SHARD, SKIPPED = 4, 1 / 32, 1 / 8
#: Candidates in a shard, queries in a matrix product, numbers in a broadcast block of queries.
SHARD, ROWS, BLOCK = 8192, 512, 4 << 20
FOUND = "query_id long, vec_id long, score long"
#: Less than any score.
NONE = -(1 << 62)


def _kind(queries: np.ndarray, shard: np.ndarray) -> type:
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * shard.shape[1]
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64


class Lists:
    """The sorted lists of a shard, read to some depth."""

    def __init__(self, shard: np.ndarray, kind: type):
        self.shard, self.kind, self.sorted = shard, kind, np.sort(shard, axis=0)
        self._sides: dict[tuple[float, bool], np.ndarray] = {}

    def bounds(self, queries: np.ndarray, depth: float, lower: bool) -> np.ndarray:
        """Upper (or lower) bounds of the scores of all candidates for each query."""
        if depth >= 1:
            return queries.astype(self.kind) @ self.shard.T.astype(self.kind)
        if (depth, lower) not in self._sides:
            read = max(1, int(len(self.shard) * depth))
            high, low = self.sorted[len(self.shard) - read], self.sorted[read - 1]
            if lower:
                sides = np.where(self.shard >= high, self.shard, self.sorted[0]), np.where(self.shard <= low, self.shard, self.sorted[-1])
            else:
                sides = np.maximum(self.shard, high), np.minimum(self.shard, low)
            self._sides[depth, lower] = np.concatenate(sides, axis=1).T.astype(self.kind)
        return np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(self.kind) @ self._sides[depth, lower]


class Search:
    """The k best candidates so far of each query of a block, all vectors of one length."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.ids = np.zeros((len(query_ids), k), np.int64)
        self.scores = np.full((len(query_ids), k), NONE, np.int64)
        self.first = 0
        #: Queries that stopped at each depth, all shards together.
        self.stopped: Counter[float] = Counter()

    def read(self, shard: np.ndarray, ids: np.ndarray) -> None:
        """One more shard of candidates."""
        lists, here = Lists(shard, _kind(self.queries, shard)), Counter()
        for i in range(0, len(self.query_ids), ROWS):
            self._read(np.arange(i, min(i + ROWS, len(self.query_ids))), lists, ids, here)
        self.stopped += here
        share = [here[d] >= SKIPPED * len(self.query_ids) for d in DEPTHS]
        self.first = max(self.first, share.index(True) if any(share) else len(DEPTHS) - 1)

    def _read(self, live: np.ndarray, lists: Lists, ids: np.ndarray, here: Counter) -> None:
        n, own_here = len(ids), np.isin(self.query_ids[live], ids).any()
        for depth in DEPTHS[self.first :]:
            queries, known = self.queries[live], self.scores[live, -1]
            upper = lists.bounds(queries, depth, False)
            own = self.query_ids[live][:, None] == ids if own_here else None
            if depth < 1 and n > self.k and (known == NONE).any():
                lower = lists.bounds(queries, depth, True)
                if own is not None:
                    lower[own] = NONE
                known = np.maximum(known, np.partition(lower, n - self.k, axis=1)[:, n - self.k].astype(np.int64))
            keep = upper >= known[:, None]
            if own is not None:
                keep &= ~own
            done = np.ones(len(live), bool) if depth >= 1 else keep.sum(axis=1) <= max(FEW * self.k, n * FEW_OF_SHARD)
            here[depth] += int(done.sum())
            for q in np.flatnonzero(done).tolist():
                found = np.flatnonzero(keep[q])
                exact = upper[q, found].astype(np.int64) if depth >= 1 else lists.shard[found] @ queries[q]
                self._merge(live[q], ids[found], exact)
            live = live[~done]
            if not len(live):
                return

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[best], scores[best]

    def found(self) -> pa.RecordBatch:
        """query_id, vec_id and score of the best."""
        some = self.scores > NONE
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.query_ids, some.sum(axis=1))), pa.array(self.ids[some]), pa.array(self.scores[some])], ["query_id", "vec_id", "score"])


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each finite vector."""
    fine: Column = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def exact_topk(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = whole_vectors(df, id_col, vec_col, scale)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    numbers = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    blocks = int(numbers // BLOCK) + 1
    path = new_path(spark, "topk")
    for b in range(blocks):
        sets: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toLocalIterator():
            sets.setdefault(len(r.v), []).append(r)
        held = spark.sparkContext.broadcast([(np.array([r.id for r in s], np.int64), np.array([r.v for r in s], np.int64).reshape(len(s), d)) for d, s in sorted(sets.items())])

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            searches = [Search(query_ids, queries, k) for query_ids, queries in held.value]
            for batch in batches:
                for i in range(0, batch.num_rows, SHARD):
                    part = batch.slice(i, SHARD)
                    ids, vectors = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                    size = np.diff(vectors.offsets.to_numpy())
                    flat = vectors.flatten().to_numpy(zero_copy_only=False)
                    for search in searches:
                        dims = search.queries.shape[1]
                        fit = size == dims
                        if fit.any():
                            search.read(flat[np.repeat(fit, size)].reshape(int(fit.sum()), dims), ids[fit])
            for search in searches:
                yield search.found()

        in_arrow(rows, scan, FOUND).write.parquet(f"{path}/block={b}")
        held.destroy()
    found = spark.read.schema(FOUND).parquet(path).drop("block")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
