"""Token-id files in canonical length-limited Huffman code.

``write`` counts ids over the whole corpus, derives code lengths of at most
``MAX_BITS`` (package-merge), orders the documents by doc_id and writes blocks of
whole documents. A block is decoded on its own: it holds its documents' ids and
counts and, every ``INTERVAL`` ids, a checkpoint of the bit offset, from which all
its segments are decoded side by side through one lookup table of the next
``MAX_BITS`` bits. ``read`` gives the documents back.

Folder: ``code`` (id, bits; the codes follow canonically), ``blocks`` (part, block,
first, n_ids, payload; ``first`` counts the ids before the block in its part, parts
and blocks ascend with doc_id). Payload, little-endian: magic ``CLH1``, documents,
ids, interval (u32 each); per document a null flag (u8), doc_id (i64) and number of
ids (u32); per segment its length in bits (u16); then the code, first bit highest.

Defined cases: null doc_ids come first; rows that share a doc_id follow in the order
of their ids' hash; a document without ids keeps its row; an empty table gives an
empty file.
"""
from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

MAX_BITS = 18
INTERVAL = 256
BLOCK_IDS = 1 << 18
_HEAD = struct.Struct("<4sIII")


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` by package-merge: at each level the
    cheapest pairs of the level below join the symbols; a symbol's length is the number
    of levels at which it is among the items needed."""
    symbols = sorted((c, s) for s, c in counts.items() if c)
    n = len(symbols)
    if n <= 1:
        return {s: 1 for _, s in symbols}
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    weights = np.array([c for c, _ in symbols], np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        items = np.concatenate([weights, packages])
        order = np.argsort(items, kind="stable")
        levels.append(np.cumsum(order < n))  # symbols among the first items
        items = items[order]
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2)
        packages = pairs.sum(axis=1)
    lengths, needed = np.zeros(n, np.int64), 2 * n - 2
    for symbols_before in reversed(levels):
        if not needed:
            break
        taken = int(symbols_before[needed - 1])
        lengths[:taken] += 1
        needed = 2 * (needed - taken)
    return {s: int(b) for (_, s), b in zip(symbols, lengths)}


class Code:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, lengths: dict[int, int]):
        size = max(lengths, default=-1) + 1
        self.bits, self.codes = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.table_id, self.table_bits = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
        code = last = 0
        for bits, symbol in sorted((b, s) for s, b in lengths.items()):
            code <<= bits - last
            last = bits
            self.bits[symbol], self.codes[symbol] = bits, code
            own = slice(code << (MAX_BITS - bits), (code + 1) << (MAX_BITS - bits))
            self.table_id[own], self.table_bits[own] = symbol, bits
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The code of all ids and the bits of each segment of ``INTERVAL`` ids."""
        if not len(ids):
            return b"", np.empty(0, np.uint16)
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        # Each code lies in a window of 64 bits from its 32-bit word on; codes share no bit, so words are sums.
        window = self.codes[ids] << (np.uint64(64) - (at & np.uint64(31)) - bits)
        word = (at >> np.uint64(5)).astype(np.int64)
        n = int(word[-1]) + 2
        words = (np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n)
                 + np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n))
        used = (int(ends[-1]) + 7) // 8
        marks = ends[np.append(np.arange(INTERVAL - 1, len(ids) - 1, INTERVAL), len(ids) - 1)]
        return words.astype(">u4").tobytes()[:used], np.diff(marks, prepend=np.uint64(0)).astype("<u2")

    def decode(self, code: bytes, segment_bits: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids: step k reads the k-th id of every segment at once."""
        if not n:
            return np.empty(0, np.uint32)
        words = np.frombuffer(code + b"\0" * (12 - len(code) % 4), ">u4").astype(np.uint64)
        ends = np.cumsum(segment_bits.astype(np.int64))
        at = ends - segment_bits
        out = np.empty((len(at), INTERVAL), np.uint32)
        last = n - (len(at) - 1) * INTERVAL
        shift = np.int64(64 - MAX_BITS)
        for k in range(min(INTERVAL, n)):
            if k == last:  # only the last segment is shorter
                at = at[:-1]
            word = at >> 5
            window = (words[word] << np.uint64(32)) | words[word + 1]
            peek = (window >> (shift - (at & 31)).astype(np.uint64)) & np.uint64((1 << MAX_BITS) - 1)
            out[:len(at), k] = self.table_id[peek]
            at = at + self.table_bits[peek]
        return out.reshape(-1)[:n]


def _payload(code: Code, docs: list, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    bits, segments = code.encode(flat)
    return b"".join([_HEAD.pack(b"CLH1", len(docs), len(flat), INTERVAL),
                     np.array([d is None for d in docs], np.uint8).tobytes(),
                     np.array([d or 0 for d in docs], "<i8").tobytes(),
                     np.array([len(x) for x in ids], "<u4").tobytes(), segments.tobytes(), bits])


def _documents(code: Code, payload: bytes) -> tuple[list, list[np.ndarray]]:
    magic, docs, n, interval = _HEAD.unpack_from(payload)
    if magic != b"CLH1" or interval != INTERVAL:
        raise ValueError("not a block of this format")
    at = _HEAD.size

    def column(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out
    null, doc_id, sizes = column("u1", docs), column("<i8", docs), column("<u4", docs)
    segments = column("<u2", -(-n // interval))
    ids = code.decode(payload[at:], segments, n)
    return ([None if z else d for z, d in zip(null.tolist(), doc_id.tolist())],
            np.split(ids, np.cumsum(sizes, dtype=np.int64)[:-1]) if docs else [])


def write(ids: DataFrame, path: str, kind: str = "<u4", counts: DataFrame | None = None) -> None:
    """Write the documents of ``ids`` (doc_id, ids: numbers of ``kind``), a stored table,
    as one file folder at ``path``. ``counts``: one column with arrays of counts by id
    (8-byte numbers) whose sum is the documents'; without it they are counted here, in a
    further pass."""
    given = counts is not None

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.zeros(1, np.int64)
        for value in batch.column(0):
            own = np.frombuffer(value.as_buffer(), np.int64) if given else np.bincount(np.frombuffer(value.as_buffer(), kind))
            if len(own) > len(found):
                found = np.pad(found, (0, len(own) - len(found)))
            found[:len(own)] += own
        seen = np.flatnonzero(found)
        return pa.record_batch({"id": pa.array(seen, pa.int64()), "n": pa.array(found[seen], pa.int64())})

    # At most one row per id of the vocabulary.
    total = {r["id"]: r["n"] for r in map_batches(ids.select("ids") if counts is None else counts, count, "id long, n long")
             .groupBy("id").agg(F.sum("n").alias("n")).collect()}
    lengths = code_lengths(total)
    spark = ids.sparkSession
    spark.createDataFrame([(int(s), b) for s, b in sorted(lengths.items())], "id long, bits int") \
        .coalesce(1).write.parquet(f"{path}/code")

    def blocks(batches):
        code, part = Code(lengths), TaskContext.get().partitionId()
        docs, held, n, block, first = [], [], 0, 0, 0

        def flush():
            return pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                                    "first": pa.array([first], pa.int64()), "n_ids": pa.array([n], pa.int64()),
                                    "payload": pa.array([_payload(code, docs, held)], pa.binary())})
        for batch in batches:
            for doc, value in zip(batch.column("doc_id"), batch.column("ids")):
                doc, own = doc.as_py(), np.frombuffer(value.as_py(), kind)
                docs.append(doc)
                held.append(own)
                n += len(own)
                if n >= BLOCK_IDS:
                    yield flush()
                    docs, held, first, n, block = [], [], first + n, 0, block + 1
        if docs:
            yield flush()

    tie = F.xxhash64("ids")
    ordered = (ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie))
    ordered.mapInArrow(blocks, "part int, block int, first long, n_ids long, payload binary") \
        .write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ``start`` counts the ids of all documents before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per part of the file: each part's ids before it.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", F.expr(
        "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before"))
    placed = blocks.join(F.broadcast(before), "part").select(
        (F.coalesce("before", F.lit(0)) + F.col("first")).alias("first"), "payload")
    # The code has one row per id of the vocabulary.
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/code").collect()}

    def decode(batches):
        code = Code(lengths)
        for batch in batches:
            for first, payload in zip(batch.column("first").to_pylist(), batch.column("payload").to_pylist()):
                docs, ids = _documents(code, payload)
                sizes = np.array([len(x) for x in ids], np.int64)
                yield pa.record_batch({
                    "doc_id": pa.array(docs, pa.int64()), "start": pa.array(first + np.cumsum(sizes) - sizes),
                    "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())})
    return placed.mapInArrow(decode, "doc_id long, start long, ids binary")
