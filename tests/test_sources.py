"""CSV scan, sinks, probes and the ETL run on inputs that the test tables lack."""
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vacanta.operators import clean as C
from vacanta.operators import market as M
from vacanta.operators import quality as Q
from vacanta.plans.etl import run_pipeline
from vacanta.plans.postings import Postings
from vacanta.sources import io as IO
from vacanta.sources.bind import RAW_COLUMNS
from conftest import SF_SMALL


def raw_rows(spark, n=20):
    return Postings(spark, SF_SMALL).raw().where("metadata_jobPostId IS NOT NULL").orderBy("metadata_jobPostId").limit(n)


def test_columns_are_taken_by_name(spark, tmp_path):
    rows = raw_rows(spark)
    IO.write_csv(rows.select(*reversed(RAW_COLUMNS)), f"{tmp_path}/a")
    got = IO.read_raw_csv(spark, f"{tmp_path}/a")
    assert got.columns == rows.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    IO.write_csv(rows.drop("title"), f"{tmp_path}/b")
    with pytest.raises(ValueError, match="title"):
        IO.read_raw_csv(spark, f"{tmp_path}/b")


def test_decimal_text_and_failures(spark):
    text = spark.createDataFrame([tuple("3000.0" if c == "salary_minimum" else "abc" if c == "salary_maximum" else "" for c in RAW_COLUMNS)],
                                 IO.RAW_TEXT_SCHEMA)
    row = IO.type_raw(text).first()
    assert row["salary_minimum"] == 3000 and row["salary_maximum"] is None
    assert {r.column_name: r.failures for r in IO.parse_failures(text).collect() if r.failures} == {"salary_maximum": 1}


def test_a_large_file_gives_several_tasks(spark, tmp_path):
    rows = raw_rows(spark, 50)
    IO.write_csv(rows.coalesce(1).crossJoin(spark.range(200)).drop("id").coalesce(1), f"{tmp_path}/c")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert IO.read_raw_csv(spark, f"{tmp_path}/c").rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lossy_date_raises(spark, tmp_path):
    rows = raw_rows(spark).withColumn("metadata_expiryDate", F.lit("31/12/2023"))
    with pytest.raises(AssertionError, match="metadata_expiryDate"):
        C.clean_dataset(rows)
    IO.write_csv(rows, f"{tmp_path}/d")
    with pytest.raises(AssertionError, match="metadata_expiryDate"):
        run_pipeline(spark, f"{tmp_path}/d", f"{tmp_path}/out")
    assert run_pipeline(spark, f"{tmp_path}/absent", f"{tmp_path}/out") is False


def test_only_a_missing_path_counts_as_absent(spark, tmp_path):
    assert not IO.table_exists(spark, f"{tmp_path}/nothing")
    os.makedirs(f"{tmp_path}/bad")
    with open(f"{tmp_path}/bad/part-0.parquet", "wb") as f:
        f.write(b"this is no parquet file")
    with pytest.raises(Exception):
        IO.load_or_empty(spark, f"{tmp_path}/bad", raw_rows(spark).schema).count()
    assert IO.load_or_empty(spark, f"{tmp_path}/nothing", raw_rows(spark).schema).count() == 0


def test_etl_run_appends(spark, tmp_path):
    IO.write_csv(Postings(spark, SF_SMALL).raw(), f"{tmp_path}/csv")
    out = f"{tmp_path}/etl"
    assert run_pipeline(spark, f"{tmp_path}/csv", out)
    n, raw = spark.read.parquet(f"{out}/jobs").count(), spark.read.parquet(f"{out}/raw")
    assert n and raw.where("loaded_at IS NULL").count() == 0
    assert spark.read.parquet(f"{out}/finance").count() == n
    assert run_pipeline(spark, f"{tmp_path}/csv", out, replace=False)
    assert spark.read.parquet(f"{out}/jobs").count() == 2 * n


def dup_rows(spark):
    rows = [("g", "2023-01-02", "b"), ("g", "2023-01-01", None), ("g", "2023-01-01", "a"), ("g", "2023-01-01", "a"),
            (None, "2023-01-01", "x"), (None, None, "y"), ("h", None, None), ("h", None, None)]
    return spark.createDataFrame(rows, "dup_group_id string, posting_date string, job_id string")


def test_one_survivor_per_group(spark):
    got = sorted((str(r.dup_group_id), str(r.posting_date), str(r.job_id)) for r in M.dedup_first_seen(dup_rows(spark)).collect())
    assert got == [("None", "2023-01-01", "x"), ("g", "2023-01-01", "a"), ("h", "None", "None")]


def test_flags_mark_one_row_of_a_group(spark):
    base = raw_rows(spark, 1)
    rows = base.union(base).union(base.withColumn("metadata_jobPostId", F.lit(None).cast("string")))
    flagged = C.clean_dataset(rows, check=False)[0]
    assert flagged.count() == 3 and flagged.where("is_first_seen").count() == 1
    assert flagged.where("is_first_seen AND metadata_jobPostId IS NOT NULL").count() == 1


def test_unknown_ids_are_not_found(spark):
    raw, jobs = Postings(spark, SF_SMALL).raw(), Postings(spark, SF_SMALL).jobs()
    known = jobs.select("job_id").first()[0]
    ids = spark.createDataFrame([(known,), ("nobody",)], "id string")
    assert dict(Q.trace_ids(ids, raw, jobs).collect()) == {known: "found", "nobody": "not_found"}


def test_table_contract_serves_the_counter_views(spark, tmp_path):
    from vacanta.operators.stats import counter_regime
    IO.insert_jobs(Postings(spark, SF_SMALL).jobs(), f"{tmp_path}/jobs")
    stored = spark.read.parquet(f"{tmp_path}/jobs")
    assert counter_regime(stored).count() > 0
    with pytest.raises(AnalysisException):
        IO.load_postings(spark, "parquet", f"{tmp_path}/none")


def test_pruning_keeps_the_contract(spark):
    from vacanta.operators import enrich as E
    jobs = Postings(spark, SF_SMALL).jobs()
    pruned = E.prune_low_value(jobs)
    assert set(jobs.columns) - set(pruned.columns) == set(E.LOW_VALUE_COLUMNS)
    with pytest.raises(ValueError, match="sector"):
        E.prune_low_value(jobs, ["sector"])
    with pytest.raises(ValueError, match="absent"):
        E.prune_low_value(pruned)


def test_profiles_of_batches_add_up(spark):
    jobs = Postings(spark, SF_SMALL).jobs().select("job_id", "sector", "salary_min", "posting_date")
    cut = F.hash("job_id") % 3 == 0
    parts = Q.profile_sketches(jobs.where(cut)).unionByName(Q.profile_sketches(jobs.where(~cut))).unionByName(Q.profile_sketches(jobs.limit(0)))
    exact = {r.column_name: r for r in Q.column_profile(jobs).collect()}
    for r in Q.merged_profile(parts).collect():
        want = exact[r.column_name]
        assert (r.nulls, r.zeros or 0) == (want.nulls, want.zeros or 0) and r.rows == jobs.count()
        assert abs(r.distinct_values - want.distinct_values) <= 0.03 * want.distinct_values
    plan = Q.column_profile(jobs)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan


def test_appended_catalog_table_is_dropped(spark):
    from vacanta.plans import catalog
    before = {t.name for t in spark.catalog.listTables()}
    assert catalog.queries()["jobs_table_append"](spark, SF_SMALL).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
