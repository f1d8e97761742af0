"""The ETL run from a CSV path: raw load, cleaning, enrichment, fact and finance tables."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..operators import clean as C
from ..operators import enrich as E
from ..operators.finance import finance_features
from ..operators.quality import StepCounts
from ..sources import io as IO
from ..sources import quarantine


def run_pipeline(spark: SparkSession, csv_path: str, out_dir: str, nrows: int | None = None, replace: bool = True,
                 multi_line: bool = False, keep_rejects: bool = False) -> bool:
    """False when ``csv_path`` does not exist; otherwise writes ``raw``, ``clean``, ``jobs``
    and ``finance`` under ``out_dir`` (replaced, or raw and jobs appended to) and returns
    True.

    The CSV is parsed once, into ``loaded``: every row is accepted or rejected with its
    reasons (``quarantine``). Rejected rows raise before a fact is written, unless
    ``keep_rejects`` leaves them under ``loaded`` and goes on with the others. Broken rules
    raise before the jobs are written. The rows left after each step are counted by the
    writes and listed under ``steps``."""
    try:
        text = IO.read_text(spark, csv_path, multi_line)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    raw, rejected = quarantine.route(text.limit(int(nrows)) if nrows is not None else text, f"{out_dir}/loaded")
    if not keep_rejects:
        C.raise_on_violations(quarantine.reject_report(rejected), "rows", "reason")
    IO.insert_raw(raw, f"{out_dir}/raw", replace)
    def store(rows, name="clean_rows"):
        IO.write_parquet(rows, f"{out_dir}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{out_dir}/{name}")
    steps = StepCounts()
    IO.write_parquet(C.clean_stored(raw, store, prune=True, steps=steps), f"{out_dir}/clean")
    enriched = E.feature_enrichment(spark.read.parquet(f"{out_dir}/clean"), store=lambda titles: store(titles, "titles"))
    IO.insert_jobs(steps.watch("enriched", enriched), f"{out_dir}/jobs", replace)
    IO.write_parquet(steps.ledger(spark), f"{out_dir}/steps")
    IO.write_parquet(finance_features(spark.read.parquet(f"{out_dir}/jobs")), f"{out_dir}/finance")
    return True
