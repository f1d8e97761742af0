"""Quality classifier by co-training.

Two logistic models see a document from two sides: its text (pairs of neighbouring
character classes, repetition and length figures) and its metadata (source, language,
size). They start from the labelled rows. In each round every model picks the
documents of an unlabelled pool of which it is surest, for each class in proportion,
and hands them with its label to the other model. In the end both are calibrated
(Platt) on labelled rows that neither was trained on, their calibrated log-odds are
added, and every document is scored from its whole text and metadata.

Models are fitted on the driver on bounded samples: the ``max_labelled`` labelled and
``pool`` unlabelled documents with the smallest keyed hash of doc_id.

Defined cases: a null text counts as empty, null metadata as values of their own;
without labels of both kinds every document is kept with score 1; a doc_id labelled
twice counts by its lowest quality, one with several texts by the smallest features;
repeated rows and null doc_ids keep their rows; other columns pass through
``keep_good`` untouched.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least, map_batches

#: Character classes by byte.
CLASSES = [b" ", b"\n", b"\t\v\f\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,", b"!?",
           b";:'\"-", b"()[]{}", b"#*$%&|<>", b"=+/\\_^~@`", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))]
_CLASS = np.zeros(256, np.uint8)
for _k, _own in enumerate(CLASSES, 1):
    _CLASS[list(_own)] = _k
_N = len(CLASSES) + 1
TEXT_SIZE = _N * _N + 7
_LANGS, _SOURCES, _SIZES = 16, 64, 16
META_SIZE = _LANGS + _SOURCES + _SIZES


def text_features(text: bytes | None) -> np.ndarray:
    text = text or b""
    kinds = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int32)
    pairs = np.bincount(kinds[:-1] * _N + kinds[1:], minlength=_N * _N) if len(kinds) else np.zeros(_N * _N)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, counts = max(len(words), 1), Counter(words)
    figures = [np.log1p(len(words)) / 10, sum(map(len, words)) / n / 10, len(counts) / n,
               sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values(), default=0) / n,
               1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)) / 5]
    return np.concatenate([np.sqrt(pairs / max(len(kinds), 1)), figures]).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_SIZE, np.float32)
    out[xxhash.xxh64_intdigest(str(lang)) % _LANGS] = 1
    out[_LANGS + xxhash.xxh64_intdigest(str(source)) % _SOURCES] = 1
    out[_LANGS + _SOURCES + (0 if n_chars is None else min(max(int(n_chars), 0).bit_length(), _SIZES - 1))] = 1
    return out


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = [text_features(t.as_py()) for t in batch.column("text").cast(pa.binary())]
    meta = [meta_features(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
    return np.array(text, np.float32).reshape(-1, TEXT_SIZE), np.array(meta, np.float32).reshape(-1, META_SIZE)


class Logistic:
    """Logistic regression by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25):
        x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        self.w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            grad = x.T @ (p - y) + penalty * self.w
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
            step = np.linalg.solve(hess, grad)
            self.w -= step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)


def _p(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


class CoTrained:
    """The two models and their calibration. The views count as independent given the
    class, as co-training assumes, so their log-odds add up over the prior's."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray],
                 rounds: int = 5, share: float = 0.05, confidence: float = 0.95):
        held = np.arange(len(y)) % 3 == 0  # rows come in hash order
        own = [([v[~held]], [y[~held]]) for v in views]
        left = np.arange(len(pool[0]))
        self.given = [0, 0]
        for _ in range(rounds):
            models = [Logistic(np.concatenate(x), np.concatenate(t)) for x, t in own]
            taken = np.zeros(len(left), bool)
            for k in (0, 1):
                if not len(left):
                    continue
                p = _p(models[k].logit(pool[k][left]))
                quota = max(1, int(share * len(left)))
                for label, sure, portion in ((1, p, y.mean()), (0, 1 - p, 1 - y.mean())):
                    best = np.argsort(-sure, kind="stable")[:max(1, int(quota * portion))]
                    best = best[(sure[best] >= confidence) & ~taken[best]]
                    taken[best] = True
                    own[1 - k][0].append(pool[1 - k][left[best]])
                    own[1 - k][1].append(np.full(len(best), float(label)))
                    self.given[k] += len(best)
            left = left[~taken]
        self.models = [Logistic(np.concatenate(x), np.concatenate(t)) for x, t in own]
        raw = [m.logit(v[held])[:, None] for m, v in zip(self.models, views)]
        self.platt = [Logistic(z, y[held], ridge=1e-3) for z in raw]
        share = np.clip(y[held].mean(), 1e-6, 1 - 1e-6)
        self.prior = float(np.log(share / (1 - share)))

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by the text, by the metadata, together."""
        each = [c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.platt, self.models, views)]
        return _p(each[0]), _p(each[1]), _p(each[0] + each[1] - self.prior)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, pool: int = 6000, seed: int = 11) -> CoTrained | None:
    """The co-trained model, or None without labels of both kinds."""
    order = F.xxhash64("doc_id", F.lit(seed))
    truth = least(labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")),
                  order, max_labelled, "doc_id")
    free = least(docs.where("doc_id IS NOT NULL").select("doc_id").distinct().join(labels.select("doc_id"), "doc_id", "left_anti"),
                 order, pool, "doc_id")
    # Bounded by max_labelled + pool rows.
    drawn = F.broadcast(truth.unionByName(free.select("doc_id", F.lit(None).cast("int").alias("quality"))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, meta = _views(batch)
        both = np.column_stack([text, meta])
        return pa.record_batch({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
                                "x": pa.array([r.tobytes() for r in both], pa.binary())})
    met = docs.select("doc_id", "text", "source", "lang", "n_chars").join(drawn, "doc_id")
    schema = T.StructType([met.schema["doc_id"], T.StructField("quality", met.schema["quality"].dataType),
                           T.StructField("x", T.BinaryType())])
    rows = (map_batches(met, run, schema).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
            .orderBy(order, "doc_id").toPandas())
    if rows["quality"].nunique() < 2:
        return None
    x = np.stack([np.frombuffer(r, np.float32) for r in rows["x"]])
    known = rows["quality"].notna().to_numpy()
    split = lambda a: (a[:, :TEXT_SIZE], a[:, TEXT_SIZE:])
    return CoTrained(split(x[known]), rows["quality"].to_numpy(float)[known], split(x[~known]))


def classify(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        text, meta, both = model.score(_views(batch)) if model else (np.ones(n),) * 3
        return pa.record_batch({"doc_id": batch.column("doc_id"), "p_text": pa.array(text), "p_meta": pa.array(meta),
                                "score": pa.array(both), "kept": pa.array(both >= threshold)})
    given = docs.select("doc_id", "text", "source", "lang", "n_chars")
    schema = T.StructType([given.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score")),
                           T.StructField("kept", T.BooleanType())])
    return map_batches(given, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fitting) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns unchanged."""
    model = fit(docs, labels, **fitting)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None or not batch.num_rows:
            return batch
        return batch.filter(pa.array(model.score(_views(batch))[2] >= threshold))
    return map_batches(docs, run, docs.schema)
