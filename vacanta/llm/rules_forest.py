"""Quality rules with an isolation forest on the rule statistics.

Each document gets a few statistics of its whole text; two base rules reject it
outright, the others only feed the forest. Trees split bounded samples of documents
at random (feature, value); a document that few splits isolate has a short mean path
and a high score. The threshold on that score is calibrated on all labelled rows that
pass the base rules: the one with the least ``good_weight`` times the share of good
rows lost plus the share of bad rows kept.

The sample is the ``trees * sample`` documents with the smallest keyed hash; it is all
that reaches the driver, beside a histogram of scores by label.

Defined cases: a null text has no words; a document without words fails the base
rules and its ratios are zero; without labels of both kinds the threshold is
``DEFAULT_THRESHOLD``; a doc_id labelled twice counts by its lowest quality; repeated
rows and null doc_ids keep their rows; other columns are not read.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least, map_batches, stored

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_lines", "n_upper", "n_marks", "n_adjacent", "n_top_word")
SYMBOLS = "#*$%&|<>"
MARKS = "!?^~=+"
DEFAULT_THRESHOLD = 0.65
_BINS = 1000


def statistics(text: str | None, window: int = 5) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for one text."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # on bytes: ASCII white space only
    seen: dict[tuple, int] = {}
    repeated = bytearray(len(words))
    for at, gram in enumerate(zip(*(words[k:] for k in range(window)))):
        first = seen.setdefault(gram, at)
        if first != at:
            repeated[first:first + window] = repeated[at:at + window] = b"\1" * window
    lines = [x for x in raw.split(b"\n") if x.split()]
    count = text.count
    spaces = sum(map(count, " \t\n\v\f\r"))
    return (len(words), len(text) - spaces, sum(map(count, SYMBOLS)), len(lines) - len(set(lines)), sum(repeated),
            len(lines), sum(map(str.isupper, text)), sum(map(count, MARKS)), sum(map(bytes.__eq__, words, words[1:])),
            max(Counter(words).values(), default=0))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics, base_failed) for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(STATISTICS))
        return pa.record_batch({"doc_id": batch.column("doc_id")}
                               | {c: pa.array(rows[:, k]) for k, c in enumerate(STATISTICS)})
    given = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([given.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in STATISTICS)])
    return map_batches(given, run, schema).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features(rows: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's view of the statistics: ratios that do not grow with the text."""
    x = {k: v.astype(np.float64) for k, v in rows.items()}
    words, chars, lines = (np.maximum(x[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    # Repeated lines count by their words: a short one that returns is no anomaly.
    return np.column_stack([x["word_chars"] / words, x["n_symbols"] / words, x["n_repeat_words"] / words,
                            x["n_upper"] / chars, x["n_marks"] / words, x["n_adjacent"] / words,
                            x["n_top_word"] / words, np.log1p(words / lines)])


def _mean_path(n) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary search tree of n values."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays: feature (-1: leaf), value, left, right, path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng, self.trees = np.random.default_rng(seed), []
        self.norm = max(float(_mean_path(min(sample, len(x)))), 1.0)
        for _ in range(trees if len(x) else 0):
            self.trees.append(self._tree(x[rng.choice(len(x), min(sample, len(x)), replace=False)], rng))

    @staticmethod
    def _tree(x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        feature, value, left, right, path = [], [], [], [], []
        todo = [(np.arange(len(x)), 0, -1, False)]
        while todo:
            own, depth, parent, is_right = todo.pop()
            node = len(feature)
            if parent >= 0:
                (right if is_right else left)[parent] = node
            low, high = x[own].min(axis=0), x[own].max(axis=0)
            can = np.flatnonzero(high > low)
            for column, start in ((feature, -1), (value, 0.0), (left, node), (right, node), (path, 0.0)):
                column.append(start)
            if depth >= limit or not len(can):
                path[node] = depth + float(_mean_path(len(own)))
                continue
            feature[node] = f = int(rng.choice(can))
            value[node] = v = float(rng.uniform(low[f], high[f]))
            below = x[own, f] <= v
            todo += [(own[below], depth + 1, node, False), (own[~below], depth + 1, node, True)]
        return tuple(np.array(c) for c in (feature, value, left, right, path))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; over about 0.5: isolated by fewer splits than the mean."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, np.where(x[rows, f] <= value[at], left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def threshold(histogram: dict[tuple[int, int], int], good_weight: float) -> float:
    """From (quality, bin of the score) -> rows; a document is kept up to the threshold."""
    good, bad = (np.array([histogram.get((q, b), 0) for b in range(_BINS + 1)], float) for q in (1, 0))
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    loss = good_weight * (1 - np.cumsum(good) / good.sum()) + np.cumsum(bad) / bad.sum()
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 + 1) / _BINS  # the middle of a gap between the classes


def judge(docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, good_weight: float = 3.0,
          seed: int = 7) -> DataFrame:
    """(doc_id, the statistics, base_failed, score, kept) for every row of ``docs``."""
    rows = stored(document_statistics(docs), "statistics")
    drawn = least(rows.where(~F.col("base_failed")), F.xxhash64("doc_id", F.lit(seed)), trees * sample, *STATISTICS).select(*STATISTICS).toPandas()
    forest = IsolationForest(features({c: drawn[c].to_numpy(np.int64) for c in STATISTICS}), trees, sample, seed)

    schema, columns = T.StructType([*rows.schema, T.StructField("score", T.DoubleType())]), rows.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = forest.score(features({c: batch.column(c).to_numpy() for c in STATISTICS}))
        return pa.record_batch({c: batch.column(c) for c in columns} | {"score": pa.array(score)})
    scored = stored(map_batches(rows, run, schema), "scores")

    truth = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    histogram = {(r["quality"], r["bin"]): r["n"] for r in
                 scored.where(~F.col("base_failed")).select("doc_id", F.floor(F.col("score") * _BINS).cast("int").alias("bin"))
                 .join(truth.where("quality IN (0, 1)"), "doc_id").groupBy("quality", "bin").agg(F.count("*").alias("n")).collect()}
    limit = threshold(histogram, good_weight)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= limit))
