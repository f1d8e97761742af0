"""T-01 with S-02, S-06 and C-08: ingest of CSV chunks that survives what goes wrong.

``start_chunk_ingest`` streams the *files* of a folder. Each micro-batch reads its files by
their own headers (columns in any order), routes every row to the accepted or the rejected
ones, cleans the accepted ones row by row and appends both to a ``Ledger`` under the
query's id and batch number, so a batch that runs twice after a failure is there once.

``start_duplicate_groups`` streams the accepted rows of that ledger into keyed state: per
same-day group its size and its first member by (date, id, row, place). The state is a
streaming aggregation: a hot group reaches the state store as one row per input task, and
a batch emits only the groups that it changed. Sizes only grow and first members only move
forward, so the changes may be merged in any order: chunks may come in any order, a late
earlier member takes its group over, and a restart repeats nothing.

``flagged`` joins the rows with their groups: the flags of ``clean.flag_duplicates`` over
everything that both streams have taken in.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as C
from ..sources import quarantine
from ..sources.io import read_text, type_raw
from ..sources.ledger import Ledger
from .ingest import clean_stateless

#: Files of one micro-batch; their headers are read by the driver.
FILES_PER_BATCH = 1000
_PLACE = ["file", "number"]
_FILE = "path string, modificationTime timestamp, length long, content binary"


def _batch_name(df: DataFrame, batch_id: int) -> str:
    """Unique to the checkpoint, the same when the batch runs again."""
    return f"{df.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")


def cleaned_rows(raw: DataFrame) -> DataFrame:
    """Accepted raw rows cleaned one by one, with the key of their duplicate group."""
    keyed = C.with_group_key(clean_stateless(raw))
    return keyed.withColumn("row_hash", C.row_hash(keyed)).withColumn("categories", F.to_json("categories"))


def start_chunk_ingest(spark: SparkSession, input_dir: str, ledger_dir: str, checkpoint_dir: str,
                       available_now: bool = True, max_files_per_trigger: int = FILES_PER_BATCH, multi_line: bool = False):
    """Start the ingest of the CSV files under ``input_dir`` (a glob) into the tables
    ``postings`` and ``rejects`` of the ledger at ``ledger_dir``."""
    files = (spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", str(max_files_per_trigger))
             .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(input_dir).select("path"))

    def take(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        ledger, name = Ledger(own, ledger_dir), _batch_name(batch, batch_id)
        if ledger.is_committed(name):
            return
        paths = [r["path"] for r in batch.select("path").collect()]  # at most max_files_per_trigger
        read = quarantine.inspect(read_text(own, paths, multi_line)).withColumn("rejected", F.size("reasons") > 0)
        # One pass over the files; the tables read what it wrote.
        ledger.append(name, {
            "loaded": read,
            "rejects": lambda done: done["loaded"].where("rejected").drop("rejected"),
            "postings": lambda done: cleaned_rows(type_raw(done["loaded"].where("NOT rejected")))})

    return _trigger(files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_dir), available_now).start()


def postings_schema(spark: SparkSession) -> T.StructType:
    """The columns of the ledger's ``postings``, known before any row is there."""
    from ..sources.io import RAW_TEXT_SCHEMA
    return cleaned_rows(type_raw(spark.createDataFrame([], RAW_TEXT_SCHEMA))).schema


def _placed(postings: DataFrame) -> DataFrame:
    """A row's place: its file, which a batch writes once, and its number there."""
    return postings.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"))


def start_duplicate_groups(spark: SparkSession, ledger_dir: str, groups_dir: str, checkpoint_dir: str,
                           available_now: bool = True, max_files_per_trigger: int = FILES_PER_BATCH,
                           first_seen_order=("metadata_originalPostingDate", "metadata_jobPostId")):
    """Start the stream that keeps every duplicate group's size and first member; the
    changes go to the table ``groups`` of the ledger at ``groups_dir``."""
    d, j = first_seen_order
    rows = _placed(spark.readStream.schema(postings_schema(spark)).option("maxFilesPerTrigger", str(max_files_per_trigger))
                   .parquet(f"{ledger_dir.rstrip('/')}/*/postings"))
    order = C.member_order(F.col(d), F.col(j), F.col("row_hash"), *map(F.col, _PLACE))
    state = rows.groupBy("dup_group_id").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))

    def emit(batch: DataFrame, batch_id: int) -> None:
        Ledger(batch.sparkSession, groups_dir).append(_batch_name(batch, batch_id), {"groups": batch})

    writer = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint_dir)
    return _trigger(writer, available_now).start()


def flagged(spark: SparkSession, ledger_dir: str, groups_dir: str) -> DataFrame:
    """The ledger's postings with dup_group_size, is_same_day_dup and is_first_seen. Rows of
    groups that the group stream has not met yet have null flags."""
    rows = _placed(Ledger(spark, ledger_dir).read("postings", postings_schema(spark)))
    groups = (Ledger(spark, groups_dir).read("groups").groupBy("dup_group_id")
              .agg(F.max("size").cast("int").alias("dup_group_size"), F.min("first").alias("first")))
    first = (F.col("file") == F.col("first.file")) & (F.col("number") == F.col("first.number"))
    return (rows.join(groups, "dup_group_id", "left").withColumn("is_same_day_dup", F.col("dup_group_size") > 1)
            .withColumn("is_first_seen", first).drop("first", "row_hash", *_PLACE))
