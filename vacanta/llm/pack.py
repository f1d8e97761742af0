"""Sequence packing by minimum bin slack.

Documents are tokenized, cut into pieces of at most ``capacity`` ids and packed
into sequences. Only a piece's length matters for packing, so the plan is made on
the histogram of lengths (at most ``capacity`` numbers, whatever the corpus): each
bin takes the largest length left and the fullest feasible combination of the
others, found by subset-sum dynamic programming on a bitset; that combination is
removed as often as the counts allow. The pieces then find their places from their
rank among pieces of equal length, which each task counts on its own and a small
table of counts per task and length makes global. No piece passes the driver.

Defined cases: a null text is empty, so its document is the end id alone; repeated
rows and null doc_ids are documents of their own; an empty table gives no rows.
Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import map_batches, stored
from .tokens import encoded, encoder

CAPACITY = 2048


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths (length -> count) with the largest sum of at
    most ``room``; larger lengths are preferred. Bit s of the bitset: sum s can be had."""
    sums, full, steps = 1, 1 << room, []
    within = (1 << (room + 1)) - 1
    for length in sorted((k for k, c in available.items() if c and k <= room), reverse=True):
        count, times = min(available[length], room // length), 1
        while count and not sums & full:
            times = min(times, count)
            steps.append((length, times, sums))
            sums |= (sums << (length * times)) & within
            count -= times
            times *= 2
        if sums & full:
            break
    total, chosen = sums.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: count in one bin})]: every bin holds the largest length left and
    the fullest combination beside it."""
    left, out = {k: c for k, c in counts.items() if c}, []
    for largest in sorted(left, reverse=True):
        while left[largest]:
            left[largest] -= 1
            bin_ = fullest(left, capacity - largest)
            left[largest] += 1
            bin_[largest] = bin_.get(largest, 0) + 1
            times = min(left[k] // c for k, c in bin_.items())
            for k, c in bin_.items():
                left[k] -= c * times
            out.append((times, bin_))
    return out


def _places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, count in one bin, offset in it)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, bin_ in bins:
        offset = 0
        for length in sorted(bin_, reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), sequence, bin_[length], offset))
            used[length] = used.get(length, 0) + times * bin_[length]
            offset += length * bin_[length]
        sequence += times
    return {k: np.array(v, np.int64).T for k, v in rows.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): documents cut into pieces, the first
    one taking the remainder; ``nth`` numbers a task's pieces of equal length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = encoder(tokenizer, end_id, special), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first_row, texts in encoded(batch, coder):
                row, piece, start, length, ids, nth = [], [], [], [], [], []
                for k, own in enumerate(texts, first_row):
                    n = len(own)
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        ids.append(own[a:b].astype("<u4", copy=False).tobytes())
                        nth.append(int(seen[b - a]))
                        seen[b - a] += 1
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary()),
                    "task": pa.array([task] * len(row), pa.int32()), "nth": pa.array(nth, pa.int64())})

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([given.schema["doc_id"], T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("task", T.IntegerType()),
                           T.StructField("nth", T.LongType())])
    return given.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece with its ids
    and its place. ``special``: strings of special tokens in a text are their ids."""
    cut = stored(pieces(docs, tokenizer, capacity, end_id, special), "pieces")
    per_task = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(counts, capacity))

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["task", "length"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy()
        rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            first, base, each, place = places[n]
            k = np.searchsorted(first, rank[own], side="right") - 1
            bin_, slot = np.divmod(rank[own] - first[k], each[k])
            sequence[own], offset[own] = base[k] + bin_, place[k] + slot * n
        given = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")}
        return pa.record_batch(given | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kept = ranked.select("doc_id", "piece", "start", "length", "ids", "nth", "before")
    schema = T.StructType([f for f in kept.schema if f.name not in ("nth", "before")]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_batches(kept, run, schema)
