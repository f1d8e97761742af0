"""Co-training: held-out accuracy, exchange of pseudo-labels, odd tables."""
import random

import numpy as np
from conftest import SF_SMALL
from helpers import docs, odd_texts

from vacanta.llm import cotrain as C
from vacanta.llm import queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = C.classify(given, C.fit(given, labels.where("doc_id % 2 = 0")))
    hidden = labels.where("doc_id % 2 = 1").join(scored, "doc_id").collect()
    good, bad = ([r.kept for r in hidden if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.15
    assert all(0 <= p <= 1 for r in hidden for p in (r.p_text, r.p_meta, r.score))


def test_views_teach_each_other():
    """Two views of 200 documents, few labelled: the second alone is learnt from the first."""
    rng = np.random.default_rng(1)
    y = (rng.random(1200) < 0.5).astype(float)
    first = np.column_stack([y * 4 + rng.normal(0, 0.5, 1200), rng.normal(0, 1, 1200)])
    second = np.column_stack([y * 2 + rng.normal(0, 0.7, 1200), rng.normal(0, 1, (1200, 10))])
    model = C.CoTrained((first[:40], second[:40]), y[:40], (first[40:800], second[40:800]))
    assert sum(model.given) > 100
    a, b, both = model.score((first[800:], second[800:]))
    assert ((both >= 0.5) == y[800:]).mean() >= max(0.97, ((b >= 0.5) == y[800:]).mean())


def test_logistic_against_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (300, 3)), (rng.random(300) < 0.3).astype(float)
    m = C.Logistic(x, y, ridge=0.5)
    p = 1 / (1 + np.exp(-(x @ m.w[:-1] + m.w[-1])))
    assert np.abs(x.T @ (p - y) + 0.5 * m.w[:-1]).max() < 1e-5


def test_odd_documents(spark):
    given = docs(spark, odd_texts(random.Random(3)) + [(100 + k, f"word{k} " * 5) for k in range(20)])
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(20)] + [(100, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = C.classify(given, C.fit(given, labels))
    assert got.count() == given.count()
    kept = C.keep_good(given, labels)
    assert kept.columns == given.columns and kept.count() == got.where("kept").count()
    one_kind = labels.where("quality = 1")
    assert C.fit(given, one_kind) is None
    assert C.keep_good(given, one_kind).count() == given.count()
    assert C.keep_good(given.limit(0), labels).count() == 0
    assert C.classify(given, C.fit(given, labels.limit(0))).where("kept").count() == given.count()


def test_query_is_stable(spark):
    run = lambda: sorted((r.doc_id, r.kept) for r in queries.queries()["op6_quality_classifier"](spark, SF_SMALL).collect())
    assert run() == run()
