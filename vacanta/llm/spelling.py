"""Spelling variants through a bit-sliced position index.

1. Words (maximal runs of letters, A-Z lower-cased) are counted per task and summed.
2. Two words one edit apart, the shorter of m code points, agree in the shorter's first
   ``m // 2`` code points or in its others at the end. Each word therefore joins four
   shards: of its first and of its last part, as the shorter and as the longer word.
3. A shard's index keeps, per position and letter, the set of its words with that letter
   there, as the bits of one integer. A query walks its letters and updates four sets for
   all words at once: those equal so far, and those with one letter replaced, one more or
   one less, which read the index at the same, the next or the previous position. Words
   that survive at their own length are exactly one edit away.
4. A shard over ``BLOCK_WORDS`` words (or ``BLOCK_CHARS`` code points) has its index split
   by hash into blocks; every word of the shard queries every block, in separate tasks.
5. A word's form is its most frequent near word if that is ``ratio`` times as frequent;
   forms are followed to the root by pointer doubling: counts grow by ``ratio`` at every
   step, so the rounds follow from the greatest count.

Defined cases: null and empty texts have no words; repeated rows count again; a null
doc_id is passed to ``spoil`` as it is; an empty table gives an empty result. Other
columns are not read.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_WORDS = 4096
BLOCK_CHARS = 1 << 17
#: Distinct words that a task holds before it hands on their counts.
_HELD = 200_000


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, spoil: Callable | None = None) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points that occur ``min_count``
    times or more. ``spoil(doc_id, word)`` may give another word for all occurrences in a
    document (no longer than the given one)."""
    letters = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or b""
                found = Counter(letters.findall(text.lower().decode(errors="replace")))  # on bytes: A-Z only
                for word, n in found.items():
                    if spoil:
                        word = spoil(doc, word)
                        if len(word) < min_length:
                            continue
                    counts[word] += n
                if len(counts) > _HELD:
                    yield out()
                    counts.clear()
        yield out()

    given = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class PositionIndex:
    """Words by position and letter; bit i of a set stands for ``words[i]``."""

    def __init__(self, words: list[str]):
        self.words = words
        self.all = (1 << len(words)) - 1
        rows: dict[tuple[int, str], list[int]] = defaultdict(list)
        lengths: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            lengths[len(word)].append(i)
            for place in enumerate(word):
                rows[place].append(i)
        self.at = {place: self._bits(own) for place, own in rows.items()}
        self.of_length = {n: self._bits(own) for n, own in lengths.items()}

    @staticmethod
    def _bits(members: list[int]) -> int:
        out = bytearray((members[-1] >> 3) + 1)
        for i in members:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    def near(self, query: str, part: int) -> tuple[int, int]:
        """The words one edit away from ``query``, and those that share its first ``part``
        letters."""
        at = self.at.get
        equal, replaced, less, more = self.all, 0, 0, 0
        shared = self.all if not part else 0
        for k, letter in enumerate(query):
            here = at((k, letter), 0)
            less = (less & at((k - 1, letter), 0)) | equal  # the word lacks this letter
            more = (more | equal) & at((k + 1, letter), 0)  # the word has one before this letter
            replaced = (replaced & here) | (equal & ~here)
            equal &= here
            if k + 1 == part:
                shared = equal
            if not (equal or replaced or less or more):
                return 0, shared
        n, of = len(query), self.of_length.get
        return (replaced & of(n, 0)) | (less & of(n - 1, 0)) | ((more | equal) & of(n + 1, 0)), shared


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in shard and block order, those to be indexed first: each row's near words of
    the block as (word, n_near, best_n, best)."""
    key, words, counts, index = None, [], [], None
    out: list[tuple] = []

    def ask(word: str, shorter: int, first: int) -> None:
        near, shared = index.near(word, shorter // 2)
        # A pair that agrees in both parts counts in the shard of the first part alone.
        near &= shared if first else ~shared
        # The shorter word of the pair has ``shorter`` letters.
        near &= index.of_length.get(shorter, 0) | (index.of_length.get(shorter + 1, 0) if len(word) == shorter else 0)
        if near:
            hits = [(-counts[i], words[i]) for i in _members(near)]
            best = min(hits)
            out.append((word, len(hits), -best[0], best[1]))

    def built() -> None:
        nonlocal index
        if index is None and key is not None:
            index = PositionIndex(words)
            for word in words:
                ask(word, key[1], key[2])

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.record_batch({"word": pa.array(columns[0], pa.string()), "n_near": pa.array(columns[1], pa.int64()),
                                "best_n": pa.array(columns[2], pa.int64()), "best": pa.array(columns[3], pa.string())})

    for batch in batches:
        names = ("shard", "shorter", "first", "block", "indexed", "word", "n")
        for *own, indexed, word, n in zip(*(batch.column(c).to_pylist() for c in names)):
            if own != key:
                built()
                key, words, counts, index = own, [], [], None
            if indexed:
                words.append(word)
                counts.append(n)
            else:
                built()
                ask(word, key[1], key[2])
        if len(out) > 10_000:
            yield flush()
    built()
    yield flush()


def near_words(words: DataFrame, min_length: int = 7, block_words: int = BLOCK_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n; stored, distinct) that
    has words one edit away: their number and the most frequent (ties: smallest)."""
    n, m = F.length("word"), F.col("shorter")
    part = (m / 2).cast("int")
    sharded = (
        words.select("word", "n", F.explode(F.array(n, n - 1)).alias("shorter")).where(m >= min_length)
        .select("word", "n", "shorter", F.explode(F.array(F.lit(1), F.lit(0))).alias("first"))
        .withColumn("shard", F.xxhash64("shorter", "first", F.when(F.col("first") == 1, F.substring(F.col("word"), F.lit(1), part))
                                        .otherwise(F.substring(F.col("word"), n - m + part + 1, n)))))
    shard = ["shard", "shorter", "first"]
    # Written, so that the planner knows the bytes of the few shards that need several blocks.
    sizes = stored(sharded.groupBy(*shard).agg(F.count("*").alias("members"), F.sum(n).alias("chars"))
                   .select(*shard, F.ceil(F.greatest(F.col("members") / block_words, F.col("chars") / block_chars)).cast("int").alias("blocks"))
                   .where("blocks > 1"), "shards")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    rows = (sharded.join(sizes, shard, "left").withColumn("own", F.pmod(F.xxhash64("word"), blocks))
            .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(*shard, "block", (F.col("own") == F.col("block")).alias("indexed"), "word", "n"))
    found = (rows.repartition(*shard, "block").sortWithinPartitions(*shard, "block", F.col("indexed").desc())
             .mapInArrow(_search, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best"))


def variant_groups(words: DataFrame, ratio: int = 10, min_length: int = 7, block_words: int = BLOCK_WORDS,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words`` (word, n; distinct)."""
    words = stored(words, "words")
    near = near_words(words, min_length, block_words, block_chars)
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "judged")
    roots = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    greatest = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(greatest, ratio)))  # no chain of forms is longer
    for _ in range(math.ceil(math.log2(steps + 1))):
        roots = stored(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
