"""Sources and sinks (S-01, S-04..S-10).

CSV columns are taken by the names in the header, read as text (no inference) and
typed with ``try_cast``; ``parse_failures`` counts the values that no type takes.
Sinks write Parquet folders, catalog tables or CSV with explicit modes; the fact-table
sink enforces the column contract and back-fills the constant columns.
"""
from __future__ import annotations

import csv
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.enrich import JOBS_COLUMNS
from ..session import compiled_code
from .bind import RAW_COLUMNS

# ---- fixed values ------------------------------------------------------------
# Types the extract's columns take once read (text unless listed).
RAW_TYPES = {
    "metadata_isPostedOnBehalf": "boolean",
    "metadata_repostCount": "int", "metadata_totalNumberJobApplication": "int",
    "metadata_totalNumberOfView": "int", "minimumYearsExperience": "int", "numberOfVacancies": "int",
    "salary_maximum": "int", "salary_minimum": "int", "status_id": "int", "average_salary": "double",
}
# Constant columns the fact-table loader back-fills when absent.
BACKFILL = {"salary_currency": "SGD", "sub_sector": "General", "seniority_years": 0}
# Columns beside the contract that some views read; kept where present.
VIEW_COLUMNS = ["status_jobStatus", "metadata_isPostedOnBehalf"]
CSV_OPTIONS = {"header": "true", "enforceSchema": "false", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# ------------------------------------------------------------------------------

#: Holds a record whose fields do not match the header, as it stands in the file.
CORRUPT = "_torn"

RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def typed_column(c: str) -> Column:
    """One raw column in its type; whole-number columns also take decimal text (3000.0),
    cut toward zero."""
    kind = RAW_TYPES.get(c)
    if kind is None:
        return F.col(c)
    if kind == "int":
        number = F.col(c).try_cast("double")
        return F.when(F.abs(number) < 2 ** 31, number.cast("int"))
    return F.col(c).try_cast(kind)


def type_raw(text: DataFrame) -> DataFrame:
    """All-text raw rows -> typed raw rows; see ``parse_failures`` for what became null."""
    return text.select(*[typed_column(c).alias(c) for c in RAW_COLUMNS])


def parse_failures(text: DataFrame) -> DataFrame:
    """(column_name, failures): non-blank texts of each typed column that its type does not take."""
    names = [c for c in RAW_COLUMNS if c in RAW_TYPES]
    wide = text.agg(*[F.count_if((F.trim(c) != "") & typed_column(c).isNull()).alias(c) for c in names])
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (column_name, failures)")


def read_raw_csv(spark: SparkSession, path: str, nrows: int | None = None, typed: bool = True,
                 multi_line: bool = False) -> DataFrame:
    """S-01: CSV scan by header names; ``nrows`` keeps the first n rows. Files are split
    between tasks unless ``multi_line`` says that quoted fields may hold line breaks. All
    files must have the first one's header; a missing column raises."""
    def scan(schema: T.StructType | None = None):
        reader = spark.read.options(**CSV_OPTIONS, multiLine=multi_line)
        return (reader.schema(schema) if schema is not None else reader).csv(path)

    header = scan().columns
    missing = [c for c in RAW_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"columns missing from the header of {path}: {missing}")
    df = scan(T.StructType([T.StructField(c, T.StringType()) for c in header])).select(*RAW_COLUMNS)
    if nrows is not None:
        df = df.limit(int(nrows))
    return type_raw(df) if typed else df


def file_headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """path -> column names in its first line, for a bounded list of files."""
    found = {}
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
        try:
            lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            found[path] = tuple(next(csv.reader([(lines.readLine() or "").removeprefix("\ufeff")]), ()))
        finally:
            stream.close()
    return found


def read_text(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """S-01 / S-02: raw columns as text with the record itself in ``CORRUPT`` where its
    fields do not match the header. ``path``: one CSV path, whose files share a header, or
    a list of files, each read by its own header (columns in any order). A missing column
    raises."""
    if isinstance(path, str):
        groups = {tuple(spark.read.options(**CSV_OPTIONS, multiLine=multi_line).csv(path).columns): [path]}
    else:
        groups = {}
        for file, header in file_headers(spark, path).items():
            if header:  # an empty file has no rows
                groups.setdefault(header, []).append(file)
    parts = []
    for header, files in groups.items():
        missing = [c for c in RAW_COLUMNS if c not in header]
        if missing:
            raise ValueError(f"columns missing from the header of {files[0]}: {missing}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
        reader = spark.read.options(**CSV_OPTIONS, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        parts.append(reader.schema(schema).csv(files).select(*RAW_COLUMNS, CORRUPT))
    if not parts:
        return spark.createDataFrame([], T.StructType([*RAW_TEXT_SCHEMA, T.StructField(CORRUPT, T.StringType())]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def extract(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame | None:
    """S-01 as the pipeline's first step: None when the path does not exist."""
    try:
        return read_raw_csv(spark, path, nrows)
    except AnalysisException as e:
        if _not_found(e):
            return None
        raise


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """S-09: CSV sink (header, RFC-4180 quoting, whitespace kept)."""
    out = df.repartition(partitions) if partitions else df
    w = out.write.mode(mode)
    for k, v in CSV_OPTIONS.items():
        if k != "enforceSchema":
            w = w.option(k, v)
    with compiled_code(df.sparkSession):
        w.csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """S-05 / S-08: Parquet sink (optionally partitioned, e.g. by posting year)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with compiled_code(df.sparkSession):
        w.parquet(path)


def fact_contract(df: DataFrame, columns=JOBS_COLUMNS) -> tuple[DataFrame, list[str]]:
    """S-06 contract: back-fill the constant columns, keep only known columns
    (in schema order), and report the ones still missing."""
    out = df
    for c, v in BACKFILL.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    order = list(columns) + [*VIEW_COLUMNS, "salary_currency", "created_at"]
    keep = [c for c in order if c in out.columns]
    missing = [c for c in order if c not in out.columns and c not in VIEW_COLUMNS]
    return out.select(*keep), missing


def write_table(df: DataFrame, name: str, replace: bool = True, path: str | None = None) -> None:
    """S-08: a catalog table (at ``path``, else in the warehouse), dropped and created, or
    appended to by column name."""
    if replace or not df.sparkSession.catalog.tableExists(name):
        w = df.write.mode("overwrite")
        (w.option("path", path) if path else w).saveAsTable(name)
    else:
        df.select(*df.sparkSession.table(name).columns).write.mode("append").saveAsTable(name)


def _is_path(name_or_path: str) -> bool:
    return "/" in name_or_path


def insert_jobs(df: DataFrame, target: str, replace: bool = True, path: str | None = None,
                batch: str | None = None) -> list[str]:
    """S-06: write the fact to a Parquet folder or catalog table (replace or append) under
    the contract; returns missing columns. With ``batch``, ``target`` is a ``Ledger`` folder
    to whose table ``jobs`` the batch is appended once."""
    out, missing = fact_contract(df)
    if batch is not None:
        from .ledger import Ledger
        Ledger(df.sparkSession, target).append(batch, {"jobs": out})
    elif _is_path(target):
        write_parquet(out, target, "overwrite" if replace else "append")
    else:
        write_table(out, target, replace, path)
    return missing


def insert_raw(raw: DataFrame, target: str, replace: bool = False) -> None:
    """S-07: the raw rows with lineage columns and ``loaded_at``, appended by default."""
    from ..operators.quality import raw_with_lineage
    out = raw_with_lineage(raw).withColumn("loaded_at", F.current_timestamp())
    if _is_path(target):
        write_parquet(out, target, "overwrite" if replace else "append")
    else:
        write_table(out, target, replace)


def _not_found(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    """S-10: a catalog table, or a Parquet path. Only a path that is not there counts as
    absent; one that cannot be read raises."""
    if not _is_path(name_or_path):
        return spark.catalog.tableExists(name_or_path)
    try:
        spark.read.parquet(name_or_path).schema
        return True
    except AnalysisException as e:
        if _not_found(e):
            return False
        raise


def load_or_empty(spark: SparkSession, name_or_path: str, schema: T.StructType) -> DataFrame:
    """S-10: the table if it exists, else an empty DataFrame with ``schema``."""
    if table_exists(spark, name_or_path):
        return spark.table(name_or_path) if "/" not in name_or_path else spark.read.parquet(name_or_path)
    return spark.createDataFrame([], schema)


def load_postings(spark: SparkSession, source: str, location: str, columns: list[str] | None = None) -> DataFrame:
    """S-04: one seam for the backend -- a catalog table or a Parquet path --
    returning the same column-pruned rows either way."""
    if source == "table":
        df = spark.table(location)
    elif source == "parquet":
        df = spark.read.parquet(location)
    else:
        raise ValueError(f"unknown source {source!r}")
    return df.select(*columns) if columns else df
