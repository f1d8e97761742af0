"""Every row read is accepted or rejected, and every defect has its reason."""
import csv

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from vacanta.plans.etl import run_pipeline
from vacanta.plans.postings import Postings
from vacanta.sources import io as IO
from vacanta.sources import quarantine as Q
from vacanta.sources.bind import RAW_COLUMNS

DEFECTS = [("salary_minimum", "5,000", "type:salary_minimum"), ("average_salary", "n/a", "type:average_salary"),
           ("metadata_isPostedOnBehalf", "perhaps", "type:metadata_isPostedOnBehalf"),
           ("numberOfVacancies", "70000", "range:numberOfVacancies"), ("metadata_repostCount", "-129", "range:metadata_repostCount"),
           ("metadata_newPostingDate", "2023-02-30", "date:metadata_newPostingDate"), ("metadata_expiryDate", "1/2/2023", "date:metadata_expiryDate"),
           ("categories", "[{'id'", "categories"), ("salary_maximum", "99999999999", "type:salary_maximum")]


@pytest.fixture(scope="module")
def good(spark):
    rows = Postings(spark, SF_SMALL).raw().where("metadata_jobPostId IS NOT NULL AND metadata_jobPostId NOT LIKE 'RANDOM%'").orderBy("metadata_jobPostId").limit(40)
    as_text = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RAW_COLUMNS])
    return [list(r) for r in as_text.collect()]


def write(path, rows, header=RAW_COLUMNS):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def planted(good):
    rows, wanted = [list(r) for r in good], []
    for k, (column, value, reason) in enumerate(DEFECTS):
        rows[k][RAW_COLUMNS.index(column)] = value
        wanted.append(reason)
    rows.append(good[20][:-3])          # too few fields
    rows.append([*good[21], "one more"])  # too many
    return rows, wanted


def test_each_defect_has_its_reason(spark, tmp_path, good):
    rows, wanted = planted(good)
    write(tmp_path / "a.csv", rows)
    accepted, rejected = Q.load(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert accepted.count() + rejected.count() == len(rows)
    report = {r["reason"]: r["rows"] for r in Q.reject_report(rejected).collect()}
    assert report == {**{w: 1 for w in wanted}, "torn": 2}
    assert {tuple(r) for r in accepted.select("metadata_jobPostId", "title").collect()} == {
        (r[RAW_COLUMNS.index("metadata_jobPostId")], r[RAW_COLUMNS.index("title")]) for r in good[len(DEFECTS):]}
    kept = rejected.where("array_contains(reasons, 'type:salary_minimum')").first()
    assert kept["salary_minimum"] == "5,000"


def test_line_breaks_in_quotes(spark, tmp_path, good):
    rows = [list(r) for r in good]
    rows[3][RAW_COLUMNS.index("title")] = "Engineer\nnight shift"
    write(tmp_path / "a.csv", rows)
    accepted, rejected = Q.load(spark, str(tmp_path / "a.csv"), str(tmp_path / "one"))
    assert rejected.count() == 2 and accepted.count() == len(rows) - 1  # both halves are torn, nothing shifts
    assert [r["reasons"] for r in rejected.collect()] == [["torn"]] * 2
    accepted, rejected = Q.load(spark, str(tmp_path / "a.csv"), str(tmp_path / "two"), multi_line=True)
    assert rejected.count() == 0 and accepted.where("title = 'Engineer\\nnight shift'").count() == 1


def test_files_by_their_own_headers(spark, tmp_path, good):
    order = list(reversed(RAW_COLUMNS))
    write(tmp_path / "a.csv", good[:10])
    write(tmp_path / "b.csv", [list(reversed(r)) for r in good[10:]], order)
    (tmp_path / "empty.csv").write_text("")
    text = IO.read_text(spark, [str(tmp_path / f"{n}.csv") for n in ("a", "b", "empty")])
    assert {r[RAW_COLUMNS.index("metadata_jobPostId")] for r in text.collect()} == {r[RAW_COLUMNS.index("metadata_jobPostId")] for r in good}
    write(tmp_path / "c.csv", [r[1:] for r in good], RAW_COLUMNS[1:])
    with pytest.raises(ValueError, match=RAW_COLUMNS[0]):
        IO.read_text(spark, [str(tmp_path / "c.csv")])


def test_the_run_refuses_or_keeps_rejects(spark, tmp_path, good):
    rows, _ = planted(good)
    write(tmp_path / "a.csv", rows)
    with pytest.raises(AssertionError, match="type:salary_minimum: 1"):
        run_pipeline(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "jobs").exists()
    assert run_pipeline(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), keep_rejects=True)
    jobs, (accepted, rejected) = spark.read.parquet(str(tmp_path / "out" / "jobs")), Q.routed(spark, str(tmp_path / "out" / "loaded"))
    assert jobs.count() == accepted.count() and accepted.count() + rejected.count() == len(rows)
