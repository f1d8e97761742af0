"""The pipeline's stages and rows against plain versions of each decision."""
import random

import corpus_pipeline
from conftest import SF_SMALL
from helpers import docs, odd_texts
from test_decontaminate import brute as leaks
from test_simhash import brute as groups
from test_tokens import check_packing

from vacanta.llm import pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_each_stage_takes_effect(spark):
    given = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    state = given
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in state.collect()]
        state = corpus_pipeline.stored(stage(spark, state, SF_SMALL), name)
        after = state.collect()
        if name != "best_fit_packing":
            assert state.columns == COLUMNS
        ids = {r.doc_id for r in after}
        if name == "quality_classifier":
            good = [d for d, _ in before if labels.get(d) == 1]
            bad = [d for d, _ in before if labels.get(d) == 0]
            assert sum(d in ids for d in good) >= 0.95 * len(good) and sum(d in ids for d in bad) <= 0.2 * len(bad)
        elif name == "simhash_near_dedup":
            assert ids == {int(c) for _, _, c in groups(before)} and len(after) == len(ids)
        elif name == "benchmark_decontamination":
            assert ids == {d for d, _ in before} - {d for d, _ in leaks(before, bench)}
        elif name == "pii":
            assert ids == {d for d, _ in before}
            old = dict(before)
            for r in after:
                assert not any(old[r.doc_id][a:b] in r.text for a, b, _ in pii.entities(old[r.doc_id]))
                assert r.n_chars == len(r.text)
        else:
            check_packing(after, before)
    assert sorted(map(str, after)) == sorted(map(str, corpus_pipeline.run(spark, SF_SMALL).collect())) or \
        len(after) == corpus_pipeline.run(spark, SF_SMALL).count()


def test_stages_take_odd_and_empty_tables(spark):
    odd = docs(spark, odd_texts(random.Random(8)))
    for state in (odd, odd.limit(0)):
        rows = state.count()
        for name, stage in corpus_pipeline.STAGES:
            state = corpus_pipeline.stored(stage(spark, state, SF_SMALL), name)
        assert (state.count() > 0) == (rows > 0)


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use inside are a caller's columns too, with repeated rows."""
    from pyspark.sql import functions as F
    names = ["n_replaced", "_again", "_hash", "_id", "text_hash", "own", "tries", "fp", "root", "component_id"]
    texts = ["Dr. Anna Schmidt wrote to anna@example.org about the plan for the year", "another text about nothing much at all"] * 2
    given = docs(spark, [(1, texts[0]), (1, texts[0]), (2, texts[1]), (3, "call +1 415 555 0123 now please")]).select(*COLUMNS)
    for k, n in enumerate(names):
        given = given.withColumn(n, F.lit(f"mine {k}"))
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.personal_data):
        out = stage(spark, given, SF_SMALL)
        assert out.columns == given.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == {1, 2, 3}
        assert all(r[n] == f"mine {k}" for r in rows for k, n in enumerate(names))
    replaced = pii.pseudonymise(given, b"a key of the test")
    assert replaced.columns == [*given.columns, "n_replaced_"]
    assert {r["n_replaced_"] > 0 for r in replaced.where("doc_id <> 2").collect()} == {True}
