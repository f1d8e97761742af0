"""S-01 / C-04 / C-10 / C-13: no row is lost in loading, each is accepted or rejected.

``inspect`` looks at raw text rows once and lists, per row, why it cannot be loaded:

| reason | the row |
|---|---|
| ``torn`` | has more or fewer fields than the header, as after an unquoted line break |
| ``type:<column>`` | has a text there that the column's type does not take |
| ``range:<column>`` | has a whole number there that its width cannot hold |
| ``date:<column>`` | has a text there that is no ``YYYY-MM-DD`` date |
| ``categories`` | has a categories text that is no list of objects |

``route`` writes all rows in one pass, split into two folders by whether they have a
reason; accepted rows are typed from there, rejected ones keep their text and reasons.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import CATEGORY_SCHEMA, DATE_COLS, INT_WIDTHS
from .bind import RAW_COLUMNS
from .io import CORRUPT, RAW_TYPES, read_text, type_raw, typed_column, write_parquet

REJECT_SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in RAW_COLUMNS], T.StructField(CORRUPT, T.StringType()),
                              T.StructField("reasons", T.ArrayType(T.StringType()))])


def _reasons() -> list[tuple[str, Column]]:
    def text(c: str) -> Column:
        return F.when(F.trim(c) != "", F.col(c))  # blank counts as null
    found = [("torn", F.col(CORRUPT).isNotNull())]
    for c in RAW_COLUMNS:
        if c in RAW_TYPES:
            found.append((f"type:{c}", text(c).isNotNull() & typed_column(c).isNull()))
        if c in INT_WIDTHS:
            bound = 2 ** (INT_WIDTHS[c] - 1)
            value = typed_column(c)
            # Impossible years are not rejected: C-07b sets them to null.
            if c != "minimumYearsExperience":
                found.append((f"range:{c}", (value < -bound) | (value >= bound)))
        if c in DATE_COLS:
            parsed = F.try_to_date(F.col(c), "yyyy-MM-dd")
            found.append((f"date:{c}", F.col(c).isNotNull() & ~F.date_format(parsed, "yyyy-MM-dd").eqNullSafe(F.col(c))))
    as_list = F.from_json("categories", CATEGORY_SCHEMA, {"mode": "PERMISSIVE"})
    found.append(("categories", text("categories").isNotNull() & as_list.isNull()))
    return found


def inspect(text: DataFrame) -> DataFrame:
    """``text`` (raw columns as text, the torn record or null) with ``reasons``. A torn row
    has that reason alone: its fields are not where they belong."""
    pairs = _reasons()
    every = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in pairs]), lambda r: r.isNotNull())
    return text.withColumn("reasons", F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("torn"))).otherwise(every))


def route(text: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): ``text`` written once under ``path``, then the accepted rows
    typed, and the rejected rows as they came with their reasons."""
    inspected = inspect(text)
    write_parquet(inspected.withColumn("rejected", F.size("reasons") > 0), path, partition_by=["rejected"])
    return routed(text.sparkSession, path)


def routed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of what ``route`` wrote under ``path``."""
    schema = T.StructType([*REJECT_SCHEMA, T.StructField("rejected", T.BooleanType())])
    stored = spark.read.schema(schema).parquet(path)
    return type_raw(stored.where(~F.col("rejected"))), stored.where("rejected").drop("rejected")


def reject_report(rejected: DataFrame) -> DataFrame:
    """(reason, rows): a row with several reasons counts under each."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def load(spark: SparkSession, csv_path: str, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of the CSV files at ``csv_path``, written under ``path``."""
    return route(read_text(spark, csv_path, multi_line), path)

