"""Registered source / sink / streaming queries (S-01, S-04, S-06, S-09, T-01)."""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators.enrich import JOBS_COLUMNS
from ..session import delete_on_exit, ensure_checkpoint_dir
from ..sources import io as IO
from ..sources import quarantine
from ..sources.bind import RAW_COLUMNS
from ..sources.ledger import Ledger
from ..streaming import chunks
from ..streaming.ingest import clean_stateless, start_ingest
from .oracle_base import BIND, CLEAN, FIN, GHOST_SQL, JOBS, with_ctes
from .etl import run_pipeline
from .postings import Postings
from .registry import register


def _scratch(spark, sf: str, name: str) -> str:
    """A fresh folder per call under the shared checkpoint folder, so a query
    run twice never appends to (or reuses the stream checkpoint of) an earlier run."""
    app = spark.sparkContext.applicationId
    digest = hashlib.sha1(sf.rstrip("/").encode()).hexdigest()[:16]
    path = f"{ensure_checkpoint_dir(spark)}/vacanta/{app}/{digest}/io/{uuid.uuid4().hex}/{name}"
    delete_on_exit(spark, path)
    return path


@register("csv_scan", with_ctes(BIND, body=f"SELECT {', '.join(RAW_COLUMNS)} FROM raw"))
def q_csv_scan(spark, sf):
    """S-09 then S-01: the raw extract written as CSV chunks and read back
    with the explicit schema and typing."""
    path = _scratch(spark, sf, "raw_csv")
    IO.write_csv(Postings(spark, sf).raw(), path)
    return IO.read_raw_csv(spark, path)


_STREAM_COLS = ["metadata_jobPostId", "title", "postedCompany_name", "primary_category", "n_categories",
                "salary_minimum", "salary_maximum", "salary_flag", "average_salary", "minimumYearsExperience",
                "metadata_newPostingDate", "listing_days", "is_repost", "source"]


@register("stream_ingest", with_ctes(BIND, CLEAN, body=f"SELECT {', '.join(_STREAM_COLS)} FROM clean"))
def q_stream_ingest(spark, sf):
    """T-01: CSV chunks -> streaming stateless cleaning -> Parquet append sink
    (availableNow trigger, checkpointed). Equals the batch cleaning on the
    stateless columns."""
    src = _scratch(spark, sf, "stream_in")
    out = _scratch(spark, sf, "stream_out")
    ckpt = _scratch(spark, sf, "stream_ckpt")
    IO.write_csv(Postings(spark, sf).raw(), src)
    q = start_ingest(spark, src, out, ckpt, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out).select(*_STREAM_COLS)


@register("stream_batch_equivalence", with_ctes(BIND, CLEAN, body=f"SELECT {', '.join(_STREAM_COLS)} FROM clean"))
def q_stream_batch(spark, sf):
    """T-01's stateless chain applied as a batch job to the raw layer."""
    return clean_stateless(Postings(spark, sf).raw()).select(*_STREAM_COLS)


@register("fact_sink", with_ctes(BIND, CLEAN, JOBS, body=f"SELECT {', '.join([*JOBS_COLUMNS, *IO.VIEW_COLUMNS])}, 'SGD' AS salary_currency FROM jobs"))
def q_fact_sink(spark, sf):
    """S-06: the fact written under the column contract (back-fill of the
    constant currency; the load stamp is dropped for the comparison)."""
    path = _scratch(spark, sf, "jobs_table")
    IO.insert_jobs(Postings(spark, sf).jobs(), path, replace=True)
    return spark.read.parquet(path).drop("created_at")


@register("jobs_table_append", with_ctes(BIND, CLEAN, JOBS, body="""SELECT job_id, title, CAST(2 AS BIGINT) AS copies, 'SGD' AS salary_currency FROM jobs
    WHERE job_id IS NOT NULL"""))
def q_jobs_table_append(spark, sf):
    """S-06 / S-08: a catalog table dropped and created, then appended to, then read through
    the catalog: every posting is there twice."""
    name = f"jobs_{uuid.uuid4().hex}"
    jobs = Postings(spark, sf).jobs()
    IO.insert_jobs(jobs, name, replace=True, path=_scratch(spark, sf, name))
    IO.insert_jobs(jobs, name, replace=False)
    appended = IO.load_postings(spark, "table", name, ["job_id", "title", "salary_currency"]).where("job_id IS NOT NULL")
    spark.sql(f"DROP TABLE {name}")  # its files lie in the scratch folder and go with the application
    return (appended.groupBy("job_id", "title", "salary_currency").agg(F.count("*").alias("copies")))


_NULL_COUNT = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in RAW_COLUMNS)


@register("raw_sink", with_ctes(BIND, body=f"""SELECT {_NULL_COUNT} AS raw_null_count, count(*) AS records, count(*) AS stamped FROM raw GROUP BY 1"""))
def q_raw_sink(spark, sf):
    """S-07: raw rows appended with lineage columns and load stamp, read back."""
    path = _scratch(spark, sf, "raw_table")
    IO.insert_raw(Postings(spark, sf).raw(), path)
    return spark.read.parquet(path).groupBy("raw_null_count").agg(F.count("*").alias("records"), F.count("loaded_at").alias("stamped"))


@register("csv_pipeline", with_ctes(BIND, CLEAN, JOBS, body=f"SELECT {', '.join(c for c in JOBS_COLUMNS)} FROM jobs"))
def q_csv_pipeline(spark, sf):
    """The whole ETL from a CSV folder: raw load, checked and pruned cleaning, enrichment,
    fact and finance sinks."""
    source, out = _scratch(spark, sf, "raw_csv"), _scratch(spark, sf, "etl")
    IO.write_csv(Postings(spark, sf).raw(), source)
    if not run_pipeline(spark, source, out):
        raise FileNotFoundError(source)
    return spark.read.parquet(f"{out}/jobs").select(*JOBS_COLUMNS)


@register("load_postings_backends", with_ctes(BIND, CLEAN, JOBS, body="""SELECT 'table' AS backend, dup_group_id, sector, salary_midpoint FROM jobs
    UNION ALL SELECT 'parquet', dup_group_id, sector, salary_midpoint FROM jobs"""))
def q_backends(spark, sf):
    """S-04: the same column-pruned rows from a catalog (temp) table and from Parquet."""
    jobs = Postings(spark, sf).jobs()
    path = _scratch(spark, sf, "jobs_parquet")
    IO.write_parquet(jobs, path)
    view = f"vacanta_jobs_{uuid.uuid4().hex}"
    jobs.createOrReplaceTempView(view)
    cols = ["dup_group_id", "sector", "salary_midpoint"]
    a = IO.load_postings(spark, "table", view, cols).withColumn("backend", F.lit("table"))
    b = IO.load_postings(spark, "parquet", path, cols).withColumn("backend", F.lit("parquet"))
    return a.unionByName(b)


@register("probed_exposure_by_sector", with_ctes(BIND, CLEAN, JOBS, FIN,
                                                 body="SELECT sector, MEDIAN(vacancy_exposure_per_opening) AS median_exposure_per_opening "
                                                      "FROM finance WHERE sector IS NOT NULL GROUP BY sector"))
def q_probed_exposure(spark, sf):
    """S-08 + S-10: the finance fact written as a table (Parquet), then read
    through the existence probe -- a missing table would give an empty frame
    with the fact's schema instead of an error -- and aggregated (M-15)."""
    from ..operators.market import exposure_by_sector
    fin = Postings(spark, sf).finance()
    path = _scratch(spark, sf, "finance_table")
    IO.write_parquet(fin, path)
    return exposure_by_sector(IO.load_or_empty(spark, path, fin.schema))


@register("stream_duplicate_flags", with_ctes(BIND, CLEAN, body="""SELECT metadata_jobPostId, dup_group_id, dup_group_size, is_same_day_dup, is_first_seen
    FROM clean"""))
def q_stream_duplicate_flags(spark, sf):
    """T-01 with C-08: chunks whose columns come in different orders, later postings first,
    through the ingest and the keyed group state after each; the flags of all rows."""
    folder = {n: _scratch(spark, sf, n) for n in ("chunks", "ledger", "groups", "ingest_state", "group_state")}
    raw = Postings(spark, sf).raw()
    late = F.coalesce(F.col("metadata_originalPostingDate") >= "1997-01-01", F.lit(True))
    for name, part in (("late", raw.where(late)), ("early", raw.where(~late).select(*reversed(RAW_COLUMNS)))):
        IO.write_csv(part, f"{folder['chunks']}/{name}")
        chunks.start_chunk_ingest(spark, folder["chunks"], folder["ledger"], folder["ingest_state"]).awaitTermination()
        chunks.start_duplicate_groups(spark, folder["ledger"], folder["groups"], folder["group_state"]).awaitTermination()
    return chunks.flagged(spark, folder["ledger"], folder["groups"]).select(
        "metadata_jobPostId", "dup_group_id", "dup_group_size", "is_same_day_dup", "is_first_seen")


@register("append_exactly_once", with_ctes(BIND, CLEAN, JOBS, body="""SELECT sector, CAST(count(*) AS BIGINT) AS postings, CAST(count(DISTINCT job_id) AS BIGINT) AS ids
    FROM jobs GROUP BY sector"""))
def q_append_exactly_once(spark, sf):
    """S-06: the fact appended in batches by posting year, each delivered twice, read once."""
    folder, jobs = _scratch(spark, sf, "ledger"), Postings(spark, sf).jobs()
    old = F.coalesce(F.year("posting_date") < 1997, F.lit(False))
    for batch, part in (("old", jobs.where(old)), ("new", jobs.where(~old)), ("old", jobs.where(old)), ("new", jobs)):
        IO.insert_jobs(part, folder, batch=batch)
    return Ledger(spark, folder).read("jobs").groupBy("sector").agg(F.count("*").alias("postings"), F.count_distinct("job_id").alias("ids"))


_ID = "metadata_jobPostId"
#: Defects planted into the raw extract: (ids that get it, column, value).
_DEFECTS = [("%17-1", "salary_minimum", "5,000"), ("%23-1", "metadata_expiryDate", "31/12/1998"), ("%31-1", "numberOfVacancies", "70000"),
            ("%43-1", "categories", '[{"id": 3'), ("%1-2", "metadata_originalPostingDate", "1998-02-30")]
_REASONS = ["type:salary_minimum", "date:metadata_expiryDate", "range:numberOfVacancies", "categories", "date:metadata_originalPostingDate"]


@register("load_reject_report", with_ctes(BIND, body="SELECT 'accepted' AS outcome, CAST(count(*) AS BIGINT) AS records FROM raw WHERE coalesce(NOT ("
          + " OR ".join(f"{_ID} LIKE '{p}'" for p, _, _ in _DEFECTS) + "), true)"
          + "".join(f" UNION ALL SELECT '{r}', count(*) FROM raw WHERE {_ID} LIKE '{p}'" for (p, _, _), r in zip(_DEFECTS, _REASONS))))
def q_load_reject_report(spark, sf):
    """S-01 / C-04 / C-10 / C-13: the raw extract with planted defects, loaded: how many
    records were accepted, and how many rejected for which reason."""
    text = Postings(spark, sf).raw().select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
    for pattern, column, value in _DEFECTS:
        text = text.withColumn(column, F.when(F.col(_ID).like(pattern), F.lit(value)).otherwise(F.col(column)))
    source = _scratch(spark, sf, "defects_csv")
    IO.write_csv(text, source)
    accepted, rejected = quarantine.load(spark, source, _scratch(spark, sf, "loaded"))
    return (accepted.agg(F.count("*").alias("records")).select(F.lit("accepted").alias("outcome"), "records")
            .unionByName(quarantine.reject_report(rejected).select(F.col("reason").alias("outcome"), F.col("rows").alias("records"))))


_BY_YEAR = [("y1", "posting_year < 1996"), ("y2", "posting_year >= 1996 AND posting_year < 1999"), ("y3", "posting_year >= 1999 OR posting_year IS NULL")]


@register("appended_profile", with_ctes(BIND, CLEAN, JOBS, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, true AS distinct_within_3_pct FROM jobs"
    for c in JOBS_COLUMNS)))
def q_appended_profile(spark, sf):
    """Q-06: profiles stored with each batch of an appended fact and merged without a look at
    its rows; the merged distinct counts are held against exact ones."""
    from ..operators.quality import column_profile, merged_profile, profile_sketches
    ledger, jobs = Ledger(spark, _scratch(spark, sf, "ledger")), Postings(spark, sf).jobs().select(*JOBS_COLUMNS)
    year = F.year("posting_date")
    for name, where in _BY_YEAR:
        part = jobs.withColumn("posting_year", year).where(where).drop("posting_year")
        ledger.append(name, {"jobs": part, "profiles": lambda done: profile_sketches(done["jobs"])})
    exact = column_profile(ledger.read("jobs", jobs.schema)).select("column_name", F.col("distinct_values").alias("exact"))
    return merged_profile(ledger.read("profiles")).join(exact, "column_name").select(
        "column_name", "rows", "nulls", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.03 * F.col("exact")).alias("distinct_within_3_pct"))


@register("run_step_counts", with_ctes(BIND, CLEAN, JOBS, body=f"""SELECT *, lag(records) OVER (ORDER BY step_no) - records AS rows_removed FROM (
    SELECT 0 AS step_no, 'raw' AS step, count(*) AS records FROM raw
    UNION ALL SELECT 1, 'ghost rows removed', count(*) FROM raw WHERE NOT ({GHOST_SQL})
    UNION ALL SELECT 2, 'synthetic rows removed', count(*) FROM clean UNION ALL SELECT 3, 'enriched', count(*) FROM jobs)"""))
def q_run_step_counts(spark, sf):
    """Q-07 / Q-02: the rows left after each step of an ETL run, counted by its own writes."""
    source, out = _scratch(spark, sf, "raw_csv"), _scratch(spark, sf, "etl")
    IO.write_csv(Postings(spark, sf).raw(), source)
    run_pipeline(spark, source, out)
    return spark.read.parquet(f"{out}/steps").select("step_no", "step", F.col("rows").alias("records"), "rows_removed")
