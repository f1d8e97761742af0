"""Chunks in any order, late members, restarts and repeated batches give the flags of one batch run."""
import uuid

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from vacanta.operators import clean as C
from vacanta.plans.postings import Postings
from vacanta.session import ensure_checkpoint_dir
from vacanta.sources import io as IO
from vacanta.sources.ledger import Ledger
from vacanta.streaming import chunks as K

FLAGS = ["metadata_jobPostId", "dup_group_id", "dup_group_size", "is_same_day_dup", "is_first_seen"]


@pytest.fixture
def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/vacanta-test/{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def raw(spark):
    rows = Postings(spark, SF_SMALL).raw().where("metadata_jobPostId IS NOT NULL")
    first = rows.orderBy("metadata_jobPostId").limit(60)
    again = first.where("metadata_jobPostId NOT LIKE 'RANDOM%'")
    late = again.withColumn("metadata_originalPostingDate", F.lit("1990-01-01")).withColumn("metadata_jobPostId", F.concat(F.lit("LATE-"), "metadata_jobPostId"))
    same = again.limit(5)  # rows that agree in every column
    return first.unionByName(late).unionByName(same).unionByName(same), late


def ingest(spark, folder, **kw):
    K.start_chunk_ingest(spark, f"{folder}/in", f"{folder}/ledger", f"{folder}/c1", **kw).awaitTermination()


def groups(spark, folder):
    K.start_duplicate_groups(spark, f"{folder}/ledger", f"{folder}/groups", f"{folder}/c2").awaitTermination()


def flags(df):
    return sorted(map(str, df.select(*FLAGS).collect()))


def test_flags_of_chunks(spark, folder, raw):
    rows, late = raw
    rows.write.parquet(f"{folder}/rows")  # the rows' one order
    rows = spark.read.parquet(f"{folder}/rows")
    is_late = F.col("metadata_jobPostId").startswith("LATE-")
    parts = [rows.where(~is_late & (F.hash("metadata_jobPostId") % 2 == 0)),
             rows.where(~is_late & (F.hash("metadata_jobPostId") % 2 != 0)).select(*reversed(rows.columns)),
             rows.where(is_late)]
    IO.write_csv(parts[0], f"{folder}/in/a", partitions=2)
    ingest(spark, folder, max_files_per_trigger=1)
    groups(spark, folder)
    before = flags(K.flagged(spark, f"{folder}/ledger", f"{folder}/groups"))
    IO.write_csv(parts[1], f"{folder}/in/b", partitions=1)
    ingest(spark, folder)
    pending = K.flagged(spark, f"{folder}/ledger", f"{folder}/groups")
    assert pending.where("dup_group_size IS NULL").count() > 0  # rows whose groups are yet to be met
    IO.write_csv(parts[2], f"{folder}/in/c", partitions=1)
    ingest(spark, folder)
    groups(spark, folder)
    groups(spark, folder)  # a restart without new rows
    got = K.flagged(spark, f"{folder}/ledger", f"{folder}/groups")
    expected, _ = C.clean_dataset(rows, check=False)
    assert flags(got) == flags(expected)
    assert got.where("is_first_seen").groupBy("dup_group_id").count().where("count <> 1").count() == 0
    assert got.where("is_first_seen AND metadata_jobPostId LIKE 'LATE-%'").count() > 0
    assert before != flags(got.where(~is_late))
    assert Ledger(spark, f"{folder}/ledger").read("rejects").count() == 0


def test_a_new_checkpoint_of_the_groups(spark, folder, raw):
    """The group stream started anew over the same ledger merges into the same flags."""
    IO.write_csv(raw[0], f"{folder}/in/a", partitions=2)
    ingest(spark, folder)
    groups(spark, folder)
    one = flags(K.flagged(spark, f"{folder}/ledger", f"{folder}/groups"))
    K.start_duplicate_groups(spark, f"{folder}/ledger", f"{folder}/groups", f"{folder}/c3", max_files_per_trigger=1).awaitTermination()
    assert flags(K.flagged(spark, f"{folder}/ledger", f"{folder}/groups")) == one


def test_a_batch_that_fails_runs_again(spark, folder, raw, monkeypatch):
    IO.write_csv(raw[0], f"{folder}/in/a", partitions=2)
    whole = K.cleaned_rows

    def fails(rows):
        raise RuntimeError("after the first table")
    monkeypatch.setattr(K, "cleaned_rows", fails)
    with pytest.raises(Exception, match="after the first table"):
        ingest(spark, folder)
    ledger = Ledger(spark, f"{folder}/ledger")
    assert ledger.batches() == []
    monkeypatch.setattr(K, "cleaned_rows", whole)
    ingest(spark, folder)
    assert len(ledger.batches()) == 1 and len(ledger.vacuum()) == 1
    assert ledger.read("loaded").count() == raw[0].count()


def test_rejects_of_a_chunk(spark, folder, raw):
    bad = raw[0].limit(7).withColumn("metadata_expiryDate", F.lit("31/12/2023"))
    IO.write_csv(bad, f"{folder}/in/a", partitions=1)
    ingest(spark, folder)
    ledger = Ledger(spark, f"{folder}/ledger")
    assert ledger.read("rejects").where("array_contains(reasons, 'date:metadata_expiryDate')").count() == 7
    assert ledger.read("postings").count() == 0


def test_ledger(spark, folder):
    ledger = Ledger(spark, folder)
    assert ledger.batches() == [] and ledger.vacuum() == []
    one, two = spark.range(3), spark.createDataFrame([(7, "x")], "id long, extra string")
    assert ledger.append("b1", {"a": one, "b": lambda done: done["a"].where("id > 0")})
    assert not ledger.append("b1", {"a": one, "b": one})  # delivered twice
    with pytest.raises(RuntimeError):
        ledger.append("b2", {"a": two, "b": lambda done: (_ for _ in ()).throw(RuntimeError("between two tables"))})
    assert ledger.batches() == ["b1"] and ledger.read("a").count() == 3 and ledger.read("b").count() == 2
    assert ledger.append("b2", {"a": two})
    assert ledger.read("a").count() == 4 and set(ledger.read("a").columns) == {"id", "extra"}
    assert ledger.read("a", one.schema).columns == ["id"]
    assert len(ledger.vacuum()) == 1 and ledger.read("a").count() == 4
    # two attempts at once: the second finds the name taken
    one.write.parquet(f"{folder}/_attempt-x/a")
    assert not ledger._commit("_attempt-x", "b1") and ledger.read("a").count() == 4 and ledger.vacuum() == []
    with pytest.raises(ValueError):
        ledger.append("_b", {"a": one})
    with pytest.raises(ValueError):
        ledger.read("absent")
    assert ledger.read("absent", one.schema).count() == 0


def test_insert_jobs_once(spark, folder):
    jobs = Postings(spark, SF_SMALL).jobs().limit(20)
    for batch in ("1", "2", "1"):
        IO.insert_jobs(jobs, folder, batch=batch)
    assert Ledger(spark, folder).read("jobs").count() == 40
