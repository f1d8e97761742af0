"""SimHash near-duplicate groups through BK-trees.

1. A 64-bit fingerprint per document: each shingle of three lower-cased words is
   hashed (XXH64, seed 42); a bit is 1 if it is set in over half of the hashes.
2. Copies meet in their fingerprint, so the rest works on distinct fingerprints.
3. Fingerprints that differ in at most ``radius`` bits are equal in all but
   ``radius`` of any number of bit blocks. Each choice of equal blocks gives a shard
   key; two linked fingerprints share a shard. More, smaller blocks are used the
   more fingerprints there are, which keeps ordinary shards at a few members.
4. A shard's members become BK-trees: a node's children hang on the edge of their
   integer Hamming distance to it, and a search follows only the edges within the
   radius of its own distance. A shard over ``part_size`` members is split into
   parts by hash; each part's tree is sent to every part of its shard and searched
   there, one task per pair of parts, so that no task holds a whole hot shard.
5. A search emits a spanning forest (each member to its root) in place of all pairs;
   a pair of parts emits one link for each pair of forests that it joins.
6. Connected components of the links, by alternating large-star and small-star steps.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; repeated rows share a group; a null doc_id is never
the smallest unless all are null (the group's id is then null). Other columns are
not read by ``near_duplicates`` and kept by ``deduplicate``.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, stored

SHINGLE = 3
RADIUS = 3
#: Shingles hashed at once; bounds the memory of a very long text.
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = (text or b"").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle))))
        total = len(words) - shingle + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    while chunk := [digest(g, 42) for g in itertools.islice(grams, _CHUNK)]:
        bits = np.unpackbits(np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the fingerprint's bits as a signed long."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary())
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                                "fp": pa.array(fps.view(np.int64))})
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = T.StructType([given.schema["doc_id"], T.StructField("text_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])
    return map_batches(given, run, schema)


class BKTree:
    """Fingerprints by Hamming distance: ``children[i]`` maps the distance to node
    ``i`` to the child that roots all fingerprints at that distance."""

    def __init__(self, values: np.ndarray):
        self.values = values = np.asarray(values, np.uint64)
        self.children: list[dict[int, int]] = [{} for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            members = todo.pop()
            root, rest = int(members[0]), members[1:]
            if not len(rest):
                continue
            distance = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(distance, kind="stable")
            edges, starts = np.unique(distance[order], return_index=True)
            for edge, group in zip(edges.tolist(), np.split(rest[order], starts[1:])):
                self.children[root][edge] = int(group[0])
                todo.append(group)

    def search(self, queries: np.ndarray, radius: int):
        """Yield (node, indices of the queries within the radius of it). All queries walk
        down together; a query follows an edge only if its own distance to the node
        differs from the edge's by at most the radius."""
        queries = np.asarray(queries, np.uint64)
        todo = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while todo:
            node, alive = todo.pop()
            distance = np.bitwise_count(queries[alive] ^ self.values[node]).astype(np.int16)
            near = alive[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = alive[np.abs(distance - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


class _Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(values: np.ndarray, radius: int) -> _Forest:
    forest = _Forest(len(values))
    if len(values) <= 16:  # a tree of so few nodes is a list
        ints = values.tolist()
        for i, j in itertools.combinations(range(len(ints)), 2):
            if (ints[i] ^ ints[j]).bit_count() <= radius:
                forest.join(i, j)
        return forest
    for node, near in BKTree(values).search(values, radius):
        for q in near.tolist():
            forest.join(node, q)
    return forest


def shard_links(part: list[int], other: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links of one part of a shard (each member to the smallest of its tree), or, with
    another part, one link for each pair of their groups that a hit joins."""
    a = np.sort(np.array(part, np.int64).view(np.uint64))
    forest = _forest(a, radius)
    if other is None:
        return [(int(a[r]), int(a[i])) for i in range(len(a)) if (r := forest.find(i)) != i]
    b = np.sort(np.array(other, np.int64).view(np.uint64))
    second = _forest(b, radius)
    links = set()
    for node, near in BKTree(b).search(a, radius):
        root = int(b[second.find(node)])
        links.update((int(a[r]), root) for r in {forest.find(q) for q in near.tolist()})
    return sorted(links)


def block_count(n: int, radius: int = RADIUS) -> int:
    """The number of blocks: enough that a shard holds about 16 of ``n`` scattered
    fingerprints. Any number over the radius gives the same links."""
    blocks = radius + 1
    while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) / blocks) > 16:
        blocks += 1
    return blocks


def _shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of keys: the fingerprint's bits in each choice of ``blocks - radius`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(number).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, part_size: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of
    all pairs within the radius."""
    blocks = block_count(distinct.count(), radius)
    keys = distinct.select("fp", F.explode(_shard_keys(F.col("fp"), blocks, radius)).alias("key"))
    keys = keys.select("fp", "key.choice", "key.bits")
    sizes = (keys.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
             .withColumn("parts", F.ceil(F.col("n") / part_size).cast("int")))
    parted = (keys.join(sizes, ["choice", "bits"])
              .withColumn("part", F.expr("int(pmod(xxhash64(fp, 7L), parts))")))
    parts = stored(parted.groupBy("choice", "bits", "parts", "part").agg(F.collect_list("fp").alias("members")), "shards")
    left = parts.select("choice", "bits", F.col("members").alias("tree"), F.col("part").alias("i"), "parts")
    alone = left.select("tree", F.lit(None).cast("array<long>").alias("queries")).where(F.size("tree") > 1)
    many = left.where("parts > 1")
    other = parts.where("parts > 1").select("choice", "bits", F.col("members").alias("queries"), F.col("part").alias("j"))
    # One task per pair of parts of a hot shard, as far as there are partitions.
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = (many.join(other, ["choice", "bits"]).where("i < j").repartition(spread, "choice", "bits", "i", "j")
              .select("queries", "tree"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        for tree, queries in zip(batch.column("tree"), batch.column("queries")):
            for x, y in shard_links(tree.as_py(), queries.as_py(), radius):
                a.append(x)
                b.append(y)
        return pa.record_batch({"a": pa.array(np.array(a, np.uint64).view(np.int64)),
                                "b": pa.array(np.array(b, np.uint64).view(np.int64))})
    work = alone.unionByName(across)
    # Rows are dealt out one shard part at a time: hot shards give many rows.
    return map_batches(work, run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the
    smallest node reachable. Large-star links each larger neighbour of a node to the
    smallest one, small-star each smaller; both keep the components, and the edges end
    as stars. Every step is a minimum per node and a join, no neighbourhood is gathered."""
    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    def star(df: DataFrame, larger: bool) -> DataFrame:
        if larger:
            ends = df.union(df.select(F.col("b"), F.col("a"))).toDF("u", "v")
        else:
            ends = df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = ends.join(low, "u")
        if larger:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u"), F.col("m")))
        return out.where("a <> b").distinct()

    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    last = signature(edges)
    for _ in range(max_rounds):
        edges = stored(star(star(edges, True), False), "edges")
        now = signature(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row of ``docs``: root is one
    fingerprint per group, component_id the smallest doc_id of the group."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    grouped = components(links(distinct.select("fp"), radius))
    rooted = (distinct.join(grouped, distinct["fp"] == grouped["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    rooted = stored(rooted, "roots")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(lowest, "root"), "fp")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: the smallest doc_id, nulls last, then
    the smallest text hash. Columns unchanged."""
    groups = near_duplicates(docs, shingle, radius)
    first = groups.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("f"), F.count("*").alias("n"))
    first = stored(first.select(F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash")), "kept")
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["_id"])
                     & (F.xxhash64(docs["text"]) == first["_hash"]), "left_semi")
    # Only repeated rows can have passed together; the count says whether there are any.
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() \
            or groups.where("doc_id is null").limit(2).count() > 1:
        text_hash = free_name(docs.columns, "_hash")
        kept = kept.withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash]).drop(text_hash)
    return kept
