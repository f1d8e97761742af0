"""Counts that the writes make as the data flows, and the checks that stop a run."""
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from vacanta.operators import clean as C
from vacanta.operators import quality as Q
from vacanta.plans.postings import Postings
from vacanta.session import stored


def store(rows):
    return stored(rows, "clean_rows")


def test_one_pass_equals_the_chain(spark):
    raw, steps = Postings(spark, SF_SMALL).raw(), Q.StepCounts()
    got, want = C.clean_stored(raw, store, steps=steps), C.clean_dataset(raw, check=False)[0]
    assert got.columns == want.columns
    flags = ["metadata_jobPostId", "title", "salary_flag", "dup_group_size", "is_first_seen"]
    assert sorted(map(str, got.select(*flags).collect())) == sorted(map(str, want.select(*flags).collect()))
    ghosts = C.remove_ghost_rows(raw)
    ledger = Q.step_ledger([("raw", raw), ("ghost rows removed", ghosts), ("synthetic rows removed", C.remove_synthetic_rows(ghosts))])
    names = ["step_no", "step", "rows", "columns", "null_cells", "rows_removed"]
    assert sorted(map(tuple, steps.ledger(spark).select(*names).collect())) == sorted(map(tuple, ledger.select(*names).collect()))


def test_no_rows(spark):
    steps = Q.StepCounts()
    assert C.clean_stored(Postings(spark, SF_SMALL).raw().limit(0), store, steps=steps).count() == 0
    assert {r["rows"] for r in steps.ledger(spark).collect()} == {0}


@pytest.mark.parametrize("column,value,rule", [("metadata_newPostingDate", "2020/01/01", "metadata_newPostingDate: 3"),
                                               ("title", None, "title_not_null: 3"), ("metadata_jobPostId", "one", "unique_id: 2"),
                                               ("metadata_expiryDate", "1980-01-01", "expiry_after_posting: 3")])
def test_broken_rules_stop_the_run(spark, column, value, rule):
    rows = Postings(spark, SF_SMALL).raw().where("metadata_jobPostId IS NOT NULL AND metadata_jobPostId NOT LIKE 'RANDOM%'").orderBy("metadata_jobPostId").limit(3)
    with pytest.raises(AssertionError, match=rule):
        C.clean_stored(stored(rows.withColumn(column, F.lit(value)), "raw"), store)
