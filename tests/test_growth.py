"""Steps shared by the facts: what a task holds must not grow with the input."""
import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from vacanta.functions.text import INVISIBLE_CLASS, WHITESPACE_CLASS, python_title, repair
from vacanta.operators import benchmark as H
from vacanta.operators import clean as C
from vacanta.operators import enrich as E
from vacanta.operators import market as M
from vacanta.plans.postings import Postings
from vacanta.session import JIT_METHOD_BYTES, compiled_code, stored
from vacanta.sources.bind import RAW_COLUMNS
from vacanta.sources.io import RAW_TYPES

SF_SMALL = "/root/testdata/sf0.001"
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _clean(spark):
    """Three postings of one title, one of another and one without."""
    rows = []
    for i, title in enumerate(["data engineer (python/sql)"] * 3 + ["security supervisor", None]):
        row = {c: "0" if c in RAW_TYPES else None for c in RAW_COLUMNS} | {
            "metadata_jobPostId": f"MCF-{i}", "title": title, "postedCompany_name": "Acme", "positionLevels": "Senior", "salary_minimum": "3000",
            "salary_maximum": str(5000 + i), "categories": '[{"id": 1, "category": "A"}, {"id": 2, "category": "B"}]',
            "metadata_newPostingDate": "2024-01-01", "metadata_originalPostingDate": "2024-01-01", "metadata_expiryDate": "2024-01-31"}
        rows.append(tuple(row[c] for c in RAW_COLUMNS))
    text = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))
    raw = text.select(*[F.col(c).cast(RAW_TYPES[c]) if c in RAW_TYPES else F.col(c) for c in RAW_COLUMNS])
    return stored(C.clean_dataset(raw, check=False)[0], "clean")


def test_postings_are_not_dealt_out_by_title(spark):
    clean = _clean(spark)
    kept = E.feature_enrichment(clean, store=lambda titles: stored(titles, "titles"))
    plan = _plan(kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    plain = E.feature_enrichment(clean).collect()
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain)) and len(plain) == 5


def test_no_fact_sorts_its_file_splits(spark, monkeypatch):
    clean = _clean(spark)
    monkeypatch.setattr(Postings, "clean", lambda self: clean)
    written = {}
    monkeypatch.setattr("vacanta.plans.postings.materialize", lambda spark, make, key, name: written.setdefault(name, make()))
    monkeypatch.setattr(Postings, "_key", lambda self: ())
    Postings(spark, "/nowhere", materialize_facts=True).finance()
    assert sorted(written) == ["finance", "jobs"]
    assert not any("Sort " in _plan(df) for df in written.values())


def test_requests_are_not_dealt_out_by_configuration(spark):
    rows = [(f"j{i}", "S", "L", "Permanent", "0", "ok", 1000.0 + i) for i in range(40)]
    market = spark.createDataFrame(rows, ", ".join(["job_id string", *[f"{d} string" for d in H.DIMS], "salary_flag string", "salary_midpoint double"]))
    market = stored(market, "market")
    requests = market.select(F.col("job_id").alias("request_id"), *H.DIMS)
    kept = H.salary_lookup(market, requests, min_n=5, store=lambda best: stored(best, "best"))
    plan = _plan(kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(str, kept.collect())) == sorted(map(str, H.salary_lookup(market, requests, min_n=5).collect()))


def test_code_limit_lasts_for_the_write_alone(spark):
    before = spark.conf.get(LIMIT)
    with compiled_code(spark):
        assert int(spark.conf.get(LIMIT)) <= JIT_METHOD_BYTES
    assert spark.conf.get(LIMIT) == before
    spark.conf.set(LIMIT, "100")
    try:
        with compiled_code(spark):
            assert spark.conf.get(LIMIT) == "100"  # a caller's lower limit holds
    finally:
        spark.conf.set(LIMIT, before)


def test_lost_dates_and_titles_as_before(spark):
    df = spark.createDataFrame([("2024-01-01",), ("",), ("x",), ("2024-1-01",), (None,)], "d string")
    assert df.agg(C.lossy_dates(["d"])["d"].alias("n")).first()["n"] == 3
    titles = spark.createDataFrame([("it's a c++ job",), (None,), ("",)], "t string").select(python_title(F.col("t"))).collect()
    assert [r[0] for r in titles] == ["It'S A C++ Job", None, ""]


def test_first_members_are_found_in_bounded_tasks(spark):
    clean = _clean(spark)
    for df in (C.flag_duplicates(clean.drop("dup_group_id", "dup_group_size", "is_same_day_dup", "is_first_seen")),
               M.dedup_first_seen(E.feature_enrichment(clean).select(*E.JOBS_COLUMNS))):
        lines = _plan(df).splitlines()
        partial = next(i for i, line in enumerate(lines) if "SortAggregate" in line and "partial_min" in line)
        below = [line for line in lines[partial + 1:] if "Scan" in line or "_order" in line and "Exchange hashpartitioning" in line]
        assert "Exchange" in below[0]  # dealt out before the sort of the aggregate


def test_cleaning_tries_no_pattern_per_character(spark):
    rows = [("2024-02-29", "It's a  job", "acme")]
    df = spark.createDataFrame(rows, "metadata_newPostingDate string, title string, postedCompany_name string")
    plan = _plan(C.normalize_text(C.parse_dates(df, ["metadata_newPostingDate"])))
    assert plan.count("translate(") >= 2 and "200B" not in plan  # every value meets one translate
    assert "cast(metadata_newPostingDate" in plan  # a date's plain form is cast


def test_repair_and_dates_as_the_patterns_have_them(spark):
    singles = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    texts = [(f"{c}a{c}{c}b ​ {c}",) for c in singles] + [(c,) for c in singles[:300]] + [("",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    spaces = F.regexp_replace(F.regexp_replace("t", INVISIBLE_CLASS, ""), WHITESPACE_CLASS + "+", " ")
    assert df.where(~F.trim(spaces).eqNullSafe(repair(F.col("t")))).count() == 0
    dates = ["2024-02-29", "2023-02-29", "2024-1-01", " 2024-01-01", "2024-01-01\n", "2024-01-01T00", "0000-01-01", "+12345-01-01", "9999-12-31",
             "2024-13-01", "1582-10-10", "", None]
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    by_pattern = F.try_to_date("d", "yyyy-MM-dd")
    both = df.select("d", by_pattern.cast("string").alias("old"), F.date_format(by_pattern, "yyyy-MM-dd").alias("text")).collect()
    assert [r["d"] for r in C.parse_dates(df, ["d"]).select(F.col("d").cast("string")).collect()] == [r["old"] for r in both]
    assert df.agg(C.lossy_dates(["d"])["d"].alias("n")).first()["n"] == sum(r["d"] is not None and r["d"] != r["text"] for r in both) == 7


def test_duplicate_flags_shuffle_no_more_than_they_need(spark):
    """F7, F16-F18: ids that were checked need no hash of the whole row, and the shuffles carry
    a group's id as its 16 bytes."""
    rows = []
    for i, (title, company, day) in enumerate([("Cook", "Acme", "01"), ("COOK", "Acme", "01"), ("cook", "Acme", "02"), ("Cook", "Bolt", "01"), (None, "Acme", "01")] * 2):
        row = {c: "0" if c in RAW_TYPES else None for c in RAW_COLUMNS} | {
            "metadata_jobPostId": f"MCF-{9 - i}" if i else None, "title": title, "postedCompany_name": company, "salary_minimum": "3000", "salary_maximum": "5000",
            "categories": '[{"id": 1, "category": "A"}]', "metadata_newPostingDate": f"2024-01-{day}",
            "metadata_originalPostingDate": None if i == 6 else f"2024-01-{day}", "metadata_expiryDate": "2024-01-31"}
        rows.append(tuple(row[c] for c in RAW_COLUMNS))
    text = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))
    raw = text.select(*[F.col(c).cast(RAW_TYPES[c]) if c in RAW_TYPES else F.col(c) for c in RAW_COLUMNS])
    rows = C.clean_rows(raw)
    held = stored(rows, "rows")
    flagged = C.flag_duplicates(held, unique_ids=True)
    plan = _plan(flagged)
    assert "xxhash64" not in plan and "unhex(" in plan
    assert not any("Exchange hashpartitioning(dup_group_id" in line for line in plan.splitlines())
    # by definition: the size of each group and its first member by (date, id), nulls last
    groups = {}
    for r in C.with_group_key(held).collect():
        groups.setdefault(r["dup_group_id"], []).append((r["metadata_originalPostingDate"] is None, str(r["metadata_originalPostingDate"]),
                                                         r["metadata_jobPostId"] is None, r["metadata_jobPostId"] or ""))
    want = sorted((g, m[3], len(ms), len(ms) > 1, m == min(ms)) for g, ms in groups.items() for m in ms)
    names = ["dup_group_id", "metadata_jobPostId", "dup_group_size", "is_same_day_dup", "is_first_seen"]
    got = sorted((r[0], r[1] or "", *r[2:]) for r in flagged.select(*names).collect())
    assert got == want and max(w[2] for w in want) == 4
    assert flagged.columns == C.flag_duplicates(held).columns and flagged.columns[0] == "dup_group_id"
    assert sorted(map(str, C.flag_duplicates(held).collect())) == sorted(map(str, flagged.collect()))


def test_stored_cleaning_flags_checked_ids(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(C, "flag_duplicates", lambda rows, **how: seen.update(how) or rows)
    raw = Postings(spark, SF_SMALL).raw()
    C.clean_stored(raw.limit(50), lambda rows: stored(rows, "rows"))
    assert seen == {"unique_ids": True}
