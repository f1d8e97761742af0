"""Rule statistics by brute force, the forest, and the verdicts."""
import random
import re
from collections import Counter

import numpy as np
from conftest import SF_SMALL
from helpers import docs, odd_texts, sentence

from vacanta.llm import queries, rules_forest as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))


def test_statistics_are_the_definition(spark):
    texts = [t for _, t in odd_texts(random.Random(1)) if t is None or len(t) < 50_000]
    texts += ["a b c d e a b c d e a b c d e", "x\nx\n\n \nx y\nx", "a\u00a0b c", "é#*$ %&|<>", "a\x1cb", "x " * 30]
    texts += [sentence(random.Random(3), 40) * 2]
    for t in texts:
        assert R.statistics(t)[:5] == plain(t), t
    got = {r.doc_id: r for r in queries.queries()["op3_quality_rules"](spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        own = plain(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == own
        assert g.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (g.base_failed and g.kept)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (2000, 4)), rng.normal(8, 1, (20, 4))])
    score = R.IsolationForest(x).score(x)
    assert score[2000:].min() > np.quantile(score[:2000], 0.98)
    assert ((score > 0) & (score < 1)).all()
    assert R.IsolationForest(np.ones((5, 3))).score(np.ones((5, 3))).shape == (5,)
    assert R.IsolationForest(np.empty((0, 3))).score(np.ones((2, 3))).tolist() == [0, 0]


def test_threshold_from_labels():
    assert R.threshold({}, 3) == R.DEFAULT_THRESHOLD == R.threshold({(1, 400): 5}, 3)
    assert 0.4 < R.threshold({(1, 390): 5, (0, 600): 5}, 3) <= 0.6


def test_held_out_labels(spark):
    """Labels of every second labelled document are hidden from the operator."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = R.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    hidden = labels.where("doc_id % 2 = 1").join(judged, "doc_id").select("quality", "kept").collect()
    good, bad = ([r.kept for r in hidden if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.92 and np.mean(bad) <= 0.15


def test_odd_documents(spark):
    given = docs(spark, odd_texts(random.Random(2)))
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = R.judge(given, labels).collect()
    assert len(got) == given.count()
    assert not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    none = spark.createDataFrame([], labels.schema)
    assert R.judge(given, none).count() == given.count()
    assert R.judge(given.limit(0), labels).count() == 0


def test_the_sample_is_the_same_under_the_bound(spark):
    """Rows under the hash bound hold the smallest ones; with too few of them all rows are sorted."""
    from pyspark.sql import functions as F

    from vacanta.llm.common import least
    order = F.xxhash64("id", F.lit(3))
    for df in (spark.range(5000), spark.range(5000).selectExpr("id % 7 AS id"), spark.range(10)):
        for k in (1, 20, 100):
            assert sorted(r[0] for r in least(df, order, k, "id").collect()) == sorted(r[0] for r in df.orderBy(order, "id").limit(k).collect())
