"""Packing of examples into sequences: vector bin packing by dot products.

An example is the ids of its text and an end id. It may have a prompt before the text, whose ids
bear no loss. What exceeds a sequence is cut off in whole sequences; the rest of each example is an
item with three demands: ids, one segment, and loss-bearing ids. Sequences are filled one by one:
among the items that fit in all three, the one whose demands, weighted by how scarce each is in the
pool, have the largest dot product with what is left of the sequence. If none fits, the item with
the most ids is cut to fill what is left. What remains of a task in the end, less than a sequence, is
cut into sequences of powers of two, which need no padding.

Nothing is shuffled: a task packs what it reads, in pools of bounded size, and its sequence ids are
its partition's. A task that is run again gives the same sequences.

Null texts are empty: their example is the end id. Null ids keep their row. Repeated rows are examples
of their own. Very long texts are cut like any other. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantail.llm.common import byte_slices, in_arrow
from spantail.llm.tokens import Encoder, described

#: Ids that wait in a pool before sequences are filled.
POOL = 1 << 19


class Packer:
    """Fills sequences; pieces come out as (example, start, length, sequence, offset).

    Items of the same ids, with as many without loss at their front, are of one kind: scores are those
    of kinds, so a choice costs as much as there are kinds, however many items wait.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.limit = np.array([max_tokens, max_segments, max_loss], float)
        self.tokens, self.segments, self.loss = max_tokens, max_segments, max_loss
        self.sequence = self.waiting = 0
        #: By ids and ids without loss: example and start of each item, in order of arrival.
        self.kinds: dict[tuple[int, int], deque[tuple[int, int]]] = {}
        self.pieces: list[tuple[int, int, int, int, int]] = []

    def add(self, example: np.ndarray, size: np.ndarray, free: np.ndarray) -> None:
        """Examples of some ids, the first `free` of which bear no loss."""
        for e, n, f in zip(example.tolist(), size.tolist(), free.tolist(), strict=True):
            start = 0
            while n - start > self.tokens or n - start - max(0, f - start) > self.loss:
                take = min(self.tokens, max(0, f - start) + self.loss)
                if take < self.tokens:  # the loss is full first: other items may fill up the sequence
                    self._wait(e, start, take, min(take, max(0, f - start)))
                else:
                    self._one(e, start, take)
                start += take
            if n - start == self.tokens:
                self._one(e, start, n - start)
            else:
                self._wait(e, start, n - start, max(0, min(n, f) - start))

    def _wait(self, example: int, start: int, size: int, free: int) -> None:
        self.kinds.setdefault((size, free), deque()).append((example, start))
        self.waiting += size

    def _one(self, example: int, start: int, length: int) -> None:
        self.pieces.append((example, start, length, self.sequence, 0))
        self.sequence += 1

    def fill(self, all_of_them: bool) -> None:
        """Sequences from the items; unless all_of_them, until less than a sequence is left."""
        while self.kinds and (self.waiting >= self.tokens or all_of_them):
            self._sequence(self.tokens if self.waiting >= self.tokens else 1 << (self.waiting.bit_length() - 1))

    def _sequence(self, room: int) -> None:
        kinds = sorted(self.kinds)
        size = np.array([k[0] for k in kinds], np.int64)
        free = np.array([k[1] for k in kinds], np.int64)
        count = np.array([len(self.kinds[k]) for k in kinds], np.int64)
        loss = size - free
        mean = np.array([(size * count).sum() / count.sum(), 1, (loss * count).sum() / count.sum()]) / self.limit
        weight = mean / self.limit**2
        left, offset = [room, self.segments, self.loss], 0

        def taken(kind: int, length: int, times: int) -> None:
            nonlocal offset
            waiting = self.kinds[kinds[kind]]
            for _ in range(times):
                e, start = waiting.popleft()
                self.pieces.append((e, start, length, self.sequence, offset))
                offset += length
            if length < size[kind]:
                self._wait(e, start + length, int(size[kind]) - length, max(0, int(free[kind]) - length))
                self.waiting -= int(size[kind]) - length
            count[kind] -= times
            self.waiting -= length * times
            left[0] -= length * times
            left[1] -= times
            left[2] -= max(0, length - int(free[kind])) * times

        while left[0] > 0 and left[1] > 0:
            fits = (count > 0) & (size <= left[0]) & (loss <= left[2])
            if fits.any():
                score = size * (weight[0] * left[0]) + weight[1] * left[1] + loss * (weight[2] * left[2])
                pick = int(np.argmax(np.where(fits, score, -1.0)))
                times = 1
                if size[pick] == size[fits].max() and loss[pick] == loss[fits].max():  # then it stays the best while it fits
                    times = min(int(count[pick]), left[0] // int(size[pick]), left[1], left[2] // int(loss[pick]) if loss[pick] else left[1])
                taken(pick, int(size[pick]), times)
            else:
                could = np.where(count > 0, np.minimum(size, np.minimum(left[0], free + left[2])), 0)
                pick = int(np.argmax(np.where(could > 0, size, 0)))
                if could[pick] <= 0:
                    break
                taken(pick, int(could[pick]), 1)
        for k in kinds:
            if not self.kinds[k]:
                del self.kinds[k]
        self.sequence += 1


def pack(
    df: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 4096,
    max_segments: int = 512,
    max_loss: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (unsigned 32-bit little-endian), loss_tokens, doc_tokens, sequence_id and offset."""
    told = described(df.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(told.value), Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 33
        #: Examples whose pieces aren't all out: doc_id, ids, ids without loss, ids that are out.
        held: dict[int, list] = {}
        number = 0

        def out() -> Iterator[pa.RecordBatch]:
            pieces, packer.pieces = packer.pieces, []
            for i in range(0, len(pieces), 4096):
                part = pieces[i : i + 4096]
                rows = {"doc_id": [], "ids": [], "loss_tokens": [], "doc_tokens": []}
                for e, start, length, _, _ in part:
                    doc_id, ids, free, _ = held[e]
                    rows["doc_id"].append(doc_id)
                    rows["ids"].append(ids[start : start + length].tobytes())
                    rows["loss_tokens"].append(length - max(0, min(free, start + length) - start))
                    rows["doc_tokens"].append(len(ids))
                    held[e][3] += length
                    if held[e][3] == len(ids):
                        del held[e]
                table = np.array(part, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc_id"], pa.int64()), pa.array(table[:, 1]), pa.array(table[:, 2]), pa.array(rows["ids"], pa.binary()), pa.array(rows["loss_tokens"], pa.int64()), pa.array(rows["doc_tokens"], pa.int64()), pa.array(base + table[:, 3]), pa.array(table[:, 4])],
                    ["doc_id", "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"],
                )

        for part in byte_slices(batches, 1, POOL * 2):
            ids, at = encoder.encode(part.column(1))
            prompts, prompt_at = encoder.encode(part.column(2)) if prompt_col else (None, np.zeros(part.num_rows + 1, np.int64))
            ids = ids.astype("<u4")
            whole = [np.concatenate([*([prompts[prompt_at[k] : prompt_at[k + 1]].astype("<u4")] if prompt_col else []), ids[at[k] : at[k + 1]], np.array([end_id], "<u4")]) for k in range(part.num_rows)]
            free = np.diff(prompt_at)
            held.update({number + k: [d, w, f, 0] for k, (d, w, f) in enumerate(zip(part.column(0).to_pylist(), whole, free.tolist(), strict=True))})
            packer.add(np.arange(number, number + len(whole)), np.array([len(w) for w in whole]), free)
            number += len(whole)
            if packer.waiting >= POOL:
                packer.fill(False)
            yield from out()
        packer.fill(True)
        yield from out()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(prompt_col).alias("prompt")] if prompt_col else []))
    return in_arrow(rows, run, "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long", encodes=True)
