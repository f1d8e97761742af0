"""Cleaning operators on hand-made frames (the reference's unit cases)."""
import json

import pytest
from pyspark.sql import functions as F

from vacanta.operators import clean as C


def test_ghost_rows_dropped(spark):
    df = spark.createDataFrame([("Engineer", "Acme", 3000, 5000), (None, None, 0, 0)],
                               "title string, company string, salary_minimum int, salary_maximum int")
    out = C.remove_ghost_rows(df).collect()
    assert len(out) == 1 and out[0]["title"] == "Engineer"


def test_partially_populated_rows_kept(spark):
    df = spark.createDataFrame([("Engineer", "Acme", 3000, 5000), (None, "Beta", 0, 0)],
                               "title string, company string, salary_minimum int, salary_maximum int")
    assert C.remove_ghost_rows(df).count() == 2


def test_synthetic_ids_dropped(spark):
    df = spark.createDataFrame([("MCF-123", "A"), ("RANDOM_JOB_456", "B"), ("ATS-789", "C"), (None, "D")],
                               "metadata_jobPostId string, title string")
    ids = sorted(r[0] or "" for r in C.remove_synthetic_rows(df).collect())
    assert ids == ["", "ATS-789", "MCF-123"]


def test_dead_columns(spark):
    df = spark.createDataFrame([("Engineer", None, "", "Monthly"), ("Analyst", None, "  ", "Monthly")],
                               "title string, all_nan string, all_blank string, constant string")
    assert C.prune_dead_columns(df).columns == ["title"]


def test_dates_roundtrip_refuses_lossy(spark):
    ok = spark.createDataFrame([("2026-01-01", "2026-01-01", "2026-02-01"), (None, None, None)],
                               ",".join(f"{c} string" for c in C.DATE_COLS))
    C.raise_on_violations(C.date_roundtrip_check(ok), "lossy_values", "column_name")
    parsed = C.parse_dates(ok).collect()
    assert str(parsed[0][0]) == "2026-01-01" and parsed[1][0] is None
    bad = spark.createDataFrame([("not-a-date", "2026-01-01", "2026-02-01")], ",".join(f"{c} string" for c in C.DATE_COLS))
    with pytest.raises(AssertionError):
        C.raise_on_violations(C.date_roundtrip_check(bad), "lossy_values", "column_name")


def test_split_categories(spark):
    rows = [("MCF-1", json.dumps([{"id": 1, "category": "IT"}, {"id": 2, "category": "Engineering"}])),
            ("MCF-2", json.dumps([{"id": 3, "category": "Finance"}])),
            ("MCF-3", "[]"), ("MCF-4", None)]
    df = spark.createDataFrame(rows, "metadata_jobPostId string, categories string")
    postings, bridge = C.split_categories(df)
    got = {r[0]: (r[1], r[2]) for r in postings.select("metadata_jobPostId", "primary_category", "n_categories").collect()}
    assert got == {"MCF-1": ("IT", 2), "MCF-2": ("Finance", 1), "MCF-3": (None, 0), "MCF-4": (None, 0)}
    assert bridge.count() == 3
    assert bridge.where("pos = 1").collect()[0]["category"] == "Engineering"


def test_malformed_categories_raise(spark):
    df = spark.createDataFrame([("MCF-1", "[{bad json")], "metadata_jobPostId string, categories string")
    with pytest.raises(Exception):
        C.parse_categories(df).collect()


def test_fix_salaries(spark):
    rows = [(1, 1, "Full Time"), (3000, 5000, "Full Time"), (150000, 200000, "Full Time"),
            (350, 400, "Internship/Attachment"), (None, None, "Full Time")]
    df = spark.createDataFrame(rows, "salary_minimum int, salary_maximum int, employmentTypes string")
    out = C.fix_salaries(df.withColumn("average_salary", F.lit(0.0))).collect()
    assert [r["salary_flag"] for r in out] == ["undisclosed", "ok", "outlier", "low_stipend", "undisclosed"]
    assert out[0]["salary_minimum"] is None and out[0]["salary_maximum"] is None
    assert out[2]["salary_maximum"] == 200000
    assert out[3]["salary_minimum"] == 350
    assert out[4]["average_salary"] is None and out[1]["average_salary"] == 4000.0


def test_cap_experience(spark):
    df = spark.createDataFrame([(0,), (5,), (500,)], "minimumYearsExperience int")
    assert [r[0] for r in C.cap_experience(df).collect()] == [0, 5, None]


def test_normalize_text(spark):
    rows = [("  chef  ", "acme  pte ltd"), ("\u200baccounts   ASSISTANT", "x"), ("emoji 👩\u200d💻 dev", "y")]
    df = spark.createDataFrame(rows, "title string, postedCompany_name string")
    out = C.normalize_text(df).collect()
    assert out[0]["title"] == "Chef" and out[0]["postedCompany_name"] == "ACME PTE LTD"
    assert out[1]["title"] == "Accounts Assistant"
    assert "\u200d" in out[2]["title"]


def test_title_case_matches_python(spark):
    from vacanta.functions.text import python_title
    samples = ["it's c++/java DEV", "hello wORLD 1st", "", "o'NEIL mc-DONALD", "ÉCOLE école", "a1b2 c-d_e"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(python_title(F.col("s"))).collect()] == [s.title() for s in samples]


def test_derived_columns(spark):
    rows = [("2026-01-01", "2026-01-15", 1, "MCF-1"), (None, "2026-01-15", 0, "ATS-2")]
    df = spark.createDataFrame(rows, "metadata_newPostingDate string, metadata_expiryDate string, "
                                     "metadata_repostCount int, metadata_jobPostId string")
    df = df.withColumns({c: F.to_date(c) for c in ["metadata_newPostingDate", "metadata_expiryDate"]})
    out = C.add_derived_columns(df).collect()
    assert out[0]["listing_days"] == 14 and out[0]["is_repost"] and out[0]["source"] == "MCF"
    assert out[1]["listing_days"] is None


def _dup_frame(spark, rows):
    schema = ("metadata_jobPostId string, title string, postedCompany_name string, employmentTypes string, "
              "positionLevels string, primary_category string, salary_minimum int, salary_maximum int, "
              "numberOfVacancies int, metadata_newPostingDate date, metadata_originalPostingDate date")
    return spark.createDataFrame(rows, schema)


def test_flag_duplicates_case_folded(spark):
    import datetime as dt
    d = dt.date(2026, 1, 1)
    rows = [("A", "Engineer", "ACME", "FT", "Pro", "IT", 1000, 2000, 1, d, d),
            ("B", "engineer", "ACME", "FT", "Pro", "IT", 1000, 2000, 1, d, d),
            ("C", "Analyst", "ACME", "FT", "Pro", "IT", 1000, 2000, 1, d, d)]
    out = {r["metadata_jobPostId"]: r for r in C.flag_duplicates(_dup_frame(spark, rows)).collect()}
    assert out["A"]["dup_group_id"] == out["B"]["dup_group_id"] != out["C"]["dup_group_id"]
    assert out["A"]["is_same_day_dup"] and out["B"]["is_same_day_dup"] and not out["C"]["is_same_day_dup"]
    assert out["A"]["is_first_seen"] and not out["B"]["is_first_seen"]


def test_hot_duplicate_group_keeps_one_first(spark):
    """One group holding most rows: size and first-seen come from a partially
    aggregated hash aggregate, so the answer is exact regardless of skew."""
    import datetime as dt
    d = dt.date(2026, 1, 1)
    rows = [(f"ID-{i:05d}", "Engineer", "ACME", "FT", "Pro", "IT", 1000, 2000, 1, d,
             dt.date(2026, 1, 1 + (i % 20))) for i in range(3000)]
    rows += [(f"X-{i}", f"Other {i}", "B", "FT", "Pro", "IT", 1, 2, 1, d, d) for i in range(50)]
    out = C.flag_duplicates(_dup_frame(spark, rows).repartition(8))
    hot = out.where("title = 'Engineer'")
    assert hot.select("dup_group_id").distinct().count() == 1
    firsts = hot.where("is_first_seen").collect()
    assert len(firsts) == 1 and firsts[0]["metadata_jobPostId"] == "ID-00000"
    assert hot.agg(F.max("dup_group_size")).collect()[0][0] == 3000


def test_validate_rules(spark):
    import datetime as dt
    schema = ("metadata_jobPostId string, title string, salary_flag string, salary_minimum int, salary_maximum int, "
              "employmentTypes string, metadata_expiryDate date, metadata_newPostingDate date")
    good = [("MCF-1", "A", "ok", 3000, 5000, "FT", dt.date(2026, 2, 1), dt.date(2026, 1, 1)),
            ("MCF-2", "B", "ok", 3000, 5000, "FT", None, dt.date(2026, 1, 1)),
            ("MCF-3", "C", "undisclosed", None, None, "FT", dt.date(2026, 2, 1), dt.date(2026, 1, 1))]
    C.raise_on_violations(C.validate_rules(spark.createDataFrame(good, schema)))
    dup = good + [("MCF-1", "D", "ok", 3000, 5000, "FT", None, None)]
    with pytest.raises(AssertionError):
        C.raise_on_violations(C.validate_rules(spark.createDataFrame(dup, schema)))
    bad_dates = [("MCF-9", "A", "ok", 3000, 5000, "FT", dt.date(2025, 12, 1), dt.date(2026, 1, 1))]
    with pytest.raises(AssertionError):
        C.raise_on_violations(C.validate_rules(spark.createDataFrame(bad_dates, schema)))


def test_clean_dataset_with_checks_on_binding(spark):
    """C-12 with pruning and all checks on the sf0.001 binding: the three dead
    source columns go, the post-conditions hold, nothing dead survives."""
    from conftest import SF_SMALL
    from vacanta.plans.postings import Postings
    raw = Postings(spark, SF_SMALL).raw()
    cleaned, bridge = C.clean_dataset(raw, prune=True, check=True)
    assert {"occupationId", "salary_type", "status_id"}.isdisjoint(cleaned.columns)
    assert "dup_group_id" in cleaned.columns and "salary_flag" in cleaned.columns
    C.assert_no_dead_columns(cleaned)
    assert bridge.count() >= cleaned.where("n_categories > 0").count()


def test_strict_clean_refuses_bad_values(spark):
    from vacanta.operators import quality as Q
    from vacanta.sources.bind import RAW_COLUMNS
    good = {c: None for c in RAW_COLUMNS}
    good.update({"metadata_jobPostId": "MCF-1", "postedCompany_name": "A", "metadata_isPostedOnBehalf": "true",
                 "metadata_repostCount": "0", "metadata_totalNumberJobApplication": "3",
                 "metadata_totalNumberOfView": "9", "minimumYearsExperience": "2", "numberOfVacancies": "1",
                 "salary_maximum": "5000", "salary_minimum": "3000", "average_salary": "4000"})
    bad = dict(good, metadata_jobPostId="MCF-2", salary_minimum="-5", metadata_repostCount="x")
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    ok = spark.createDataFrame([tuple(good[c] for c in RAW_COLUMNS)], schema)
    assert Q.strict_clean(ok, check=True).count() == 1
    df = spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in (good, bad)], schema)
    rules = {r["rule"]: r["violations"] for r in Q.strict_type_rules(df).collect()}
    assert rules["int_metadata_repostCount"] == 1 and rules["non_negative_salary_minimum"] == 1
    with pytest.raises(AssertionError):
        Q.strict_clean(df, check=True)


def test_generic_dedup_hot_group(spark):
    """W-01 on a stored fact (no first-seen flag): a group holding most rows
    still yields exactly its earliest (posting_date, job_id) member."""
    import datetime as dt
    from vacanta.operators.market import dedup_first_seen
    rows = [("G-hot", f"J{i:05d}", dt.date(2026, 1, 1 + i % 28)) for i in range(4000)]
    rows += [("G-hot", "J-null-date", None)]
    rows += [(f"G{i}", f"K{i}", dt.date(2026, 2, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "dup_group_id string, job_id string, posting_date date").repartition(8)
    out = {r["dup_group_id"]: r["job_id"] for r in dedup_first_seen(df).collect()}
    assert len(out) == 41 and out["G-hot"] == "J00000"
