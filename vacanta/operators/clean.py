"""Cleaning operators (raw extract -> cleaned postings).

Every operator is a lazy ``DataFrame -> DataFrame`` transformation; the
checks (date round trip, validation rules, dead columns) are separate
operators that return small rule/violation tables, and ``raise_on_violations``
turns one of them into an action that raises.  Order of the chain in
``clean_dataset``: junk rows, structure, values, then derived columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import all_of, first_match
from ..functions.text import leading_letters, python_title, repair

# ---- fixed values ------------------------------------------------------------
SALARY_FLOOR = 500
SALARY_CEILING = 100_000
INTERN_STIPEND_FLOOR = 300
SYNTHETIC_ID_RE = "^RANDOM_JOB_"
EXPERIENCE_MAX = 100
INTERNSHIP_TYPE = "Internship/Attachment"
DATE_COLS = ["metadata_newPostingDate", "metadata_originalPostingDate", "metadata_expiryDate"]
# Same-day duplicate key (title compared case-folded; nulls compare equal).
DUP_KEY = ["title", "postedCompany_name", "employmentTypes", "positionLevels",
           "primary_category", "salary_minimum", "salary_maximum", "numberOfVacancies",
           "metadata_newPostingDate"]
# Integer columns and the width they must fit (C-10).
INT_WIDTHS = {"minimumYearsExperience": 8, "metadata_repostCount": 8,
              "numberOfVacancies": 16, "metadata_totalNumberOfView": 32,
              "metadata_totalNumberJobApplication": 32, "listing_days": 16,
              "n_categories": 8}
# ------------------------------------------------------------------------------

CATEGORY_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("category", T.StringType()),
]))

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _kinds(df: DataFrame):
    num, boo, text = [], [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, _NUMERIC):
            num.append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            boo.append(f.name)
        else:
            text.append(f.name)
    return num, boo, text


def is_ghost(df: DataFrame) -> Column:
    """C-01 predicate: every text column null and every numeric null-or-0
    (boolean columns are ignored)."""
    num, _, text = _kinds(df)
    conds = [F.col(c).isNull() for c in text] + [F.coalesce(F.col(c), F.lit(0)) == 0 for c in num]
    return all_of(conds)


def remove_ghost_rows(df: DataFrame) -> DataFrame:
    """C-01: drop structurally empty rows."""
    return df.where(~is_ghost(df))


def is_synthetic(id_col: str = "metadata_jobPostId") -> Column:
    return F.coalesce(F.col(id_col).rlike(SYNTHETIC_ID_RE), F.lit(False))


def remove_synthetic_rows(df: DataFrame, id_col: str = "metadata_jobPostId") -> DataFrame:
    """C-02: drop generated test rows (null ids are kept)."""
    return df.where(~is_synthetic(id_col))


def dead_column_scan(df: DataFrame) -> DataFrame:
    """C-03 report: one row per column with its non-blank count, whether it
    holds at most one distinct non-null value (``min = max``), and whether
    the column is dead (all null/blank, or constant).

    One aggregation pass of counts and min/max per column: no per-column
    ``count(DISTINCT)``, which would replicate every row once per column."""
    _, _, text = _kinds(df)
    aggs = []
    for c in df.columns:
        x = F.col(c)
        if c in text:
            nonblank = F.sum(F.when(F.trim(x.cast("string")) != "", 1).otherwise(0))
        else:
            nonblank = F.count(x)
        aggs += [nonblank.cast("long").alias(f"{c}__nb"),
                 F.min(x).eqNullSafe(F.max(x)).alias(f"{c}__one")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__nb`, `{c}__one`" for c in df.columns)
    long = wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, non_blank, at_most_one_value)")
    return long.withColumn("is_dead", (F.col("non_blank") == 0) | F.col("at_most_one_value"))


def prune_dead_columns(df: DataFrame) -> DataFrame:
    """C-03: drop dead columns. Deciding the schema needs one small action
    (a one-row-per-column report); the data itself stays distributed."""
    dead = [r["column_name"] for r in dead_column_scan(df).where("is_dead").collect()]
    return df.drop(*dead)


def assert_no_dead_columns(df: DataFrame) -> None:
    """C-11: re-run the dead-column scan on a cleaned frame and raise if any
    column is blank or constant (meaningful on full data only)."""
    dead = [r["column_name"] for r in dead_column_scan(df).where("is_dead").collect()]
    if dead:
        raise AssertionError(f"zero-variance or blank columns survived to the cleaned frame: {dead}")


def _plain_date(c: str) -> Column:
    """Whether a text has the plain form of a date, which the cast reads as the pattern
    ``yyyy-MM-dd`` does, and faster."""
    return F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z")


def _date(c: str) -> Column:
    return F.when(_plain_date(c), F.col(c).try_cast("date")).otherwise(F.try_to_date(F.col(c), "yyyy-MM-dd"))


def date_roundtrip_check(df: DataFrame, cols=DATE_COLS) -> DataFrame:
    """C-04 report: per date column, values that do not survive a round trip
    through a ``YYYY-MM-DD`` date (non-null text that is not such a date)."""
    wide = df.agg(*[n.alias(c) for c, n in lossy_dates(cols).items()])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, lossy_values)")


def parse_dates(df: DataFrame, cols=DATE_COLS) -> DataFrame:
    """C-04: string dates to DATE. A value that is no such date becomes null here;
    ``clean_dataset`` refuses it before (``date_roundtrip_check``)."""
    return df.withColumns({c: _date(c) for c in cols})


def parse_categories(df: DataFrame, col: str = "categories", permissive: bool = False) -> DataFrame:
    """C-05, structural half: the JSON text becomes a typed
    ``array<struct<id,category>>`` (list order kept). Malformed JSON raises
    (FAILFAST) unless ``permissive``, where it becomes an empty list."""
    mode = "PERMISSIVE" if permissive else "FAILFAST"
    parsed = F.from_json(F.col(col), CATEGORY_SCHEMA, {"mode": mode})
    arr = F.coalesce(parsed, F.array().cast(CATEGORY_SCHEMA))
    return (df.withColumn(col, arr)
            .withColumn("primary_category", F.get(F.col(col), 0).getField("category"))
            .withColumn("n_categories", F.size(F.col(col)).cast("int")))


def category_bridge(df: DataFrame, id_col: str = "metadata_jobPostId", col: str = "categories") -> DataFrame:
    """C-05 bridge: one row per (posting, category), with its list position."""
    return (df.select(id_col, F.posexplode(col).alias("pos", "c"))
            .select(id_col, "pos", F.col("c.id").cast("short").alias("category_id"),
                    F.col("c.category").alias("category")))


def split_categories(df: DataFrame, id_col: str = "metadata_jobPostId"):
    """C-05: ``(postings, bridge)``; postings gain primary_category/n_categories."""
    parsed = parse_categories(df)
    return parsed, category_bridge(parsed, id_col)


def salary_flag(smin: str = "salary_minimum", smax: str = "salary_maximum",
                job_type: str = "employmentTypes") -> tuple[Column, Column]:
    """C-07 rule: returns (below_floor, flag)."""
    lo, hi = F.col(smin), F.col(smax)
    low_min = F.coalesce(lo < SALARY_FLOOR, F.lit(True))
    low_max = F.coalesce(hi < SALARY_FLOOR, F.lit(True))
    high_max = F.coalesce(hi > SALARY_CEILING, F.lit(False))
    internship = F.coalesce(F.col(job_type) == INTERNSHIP_TYPE, F.lit(False))
    stipend = (internship & low_min & low_max
               & F.coalesce(lo >= INTERN_STIPEND_FLOOR, F.lit(False))
               & F.coalesce(hi >= INTERN_STIPEND_FLOOR, F.lit(False)))
    below = (low_min | low_max) & ~stipend
    flag = first_match([(below, "undisclosed"), (stipend, "low_stipend"), (high_max, "outlier")], "ok")
    return below, flag


def fix_salaries(df: DataFrame) -> DataFrame:
    """C-07: null placeholder salaries in pairs, flag outliers (kept), carve out
    internship stipends, recompute average_salary."""
    below, flag = salary_flag()
    out = df.withColumns({
        "salary_flag": flag,
        "salary_minimum": F.when(~below, F.col("salary_minimum").cast("int")),
        "salary_maximum": F.when(~below, F.col("salary_maximum").cast("int")),
    })
    return out.withColumn("average_salary",
                          ((F.col("salary_minimum") + F.col("salary_maximum")) / 2.0).cast("double"))


def cap_experience(df: DataFrame, col: str = "minimumYearsExperience") -> DataFrame:
    """C-07b: impossible years (> 100) become null; 0 is kept."""
    x = F.col(col).cast("int")
    return df.withColumn(col, F.when(~F.coalesce(x > EXPERIENCE_MAX, F.lit(False)), x))


def normalize_text(df: DataFrame, title_case: bool = True) -> DataFrame:
    """C-06: repair title (then Python-style title case) and company (upper first)."""
    out = df.withColumns({
        "title": repair(F.col("title")),
        "postedCompany_name": repair(F.upper(F.col("postedCompany_name"))),
    })
    return out.withColumn("title", python_title(F.col("title"))) if title_case else out


def add_derived_columns(df: DataFrame) -> DataFrame:
    """C-07c: listing_days (expiry - latest posting date), is_repost, source."""
    return df.withColumns({
        "listing_days": F.datediff("metadata_expiryDate", "metadata_newPostingDate").cast("int"),
        "is_repost": F.col("metadata_repostCount") > 0,
        "source": leading_letters(F.col("metadata_jobPostId")),
    })


def _key_text(c: Column) -> Column:
    """Unambiguous text form of one key part: length-prefixed, null marked."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def dup_key_id(cols) -> Column:
    """Deterministic group id of a key (nulls equal): md5 of its text form.
    Computed per row, so it needs no global numbering pass."""
    return F.md5(F.concat_ws("|", *[_key_text(c) for c in cols]))


def grouping_key(cols) -> Column:
    """Fixed-width 128-bit grouping key of ``cols`` (nulls equal): two
    differently-salted xxhash64 values, each column preceded by its null flag
    (Spark's hash skips nulls, so the flag keeps positions distinct). For
    counting groups only -- a hash aggregate with no string building."""
    parts = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))


def with_group_key(df: DataFrame) -> DataFrame:
    """``df`` with the hash of its same-day duplicate key as dup_group_id."""
    return df.withColumn("dup_group_id", dup_key_id([F.lower(F.col("title")) if c == "title" else F.col(c) for c in DUP_KEY]))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, nulls told apart."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))])


def member_order(date: Column, row_id: Column, whole: Column | None, *place: Column) -> Column:
    """Order of a duplicate group's members: by date, then id, nulls last, then the row's
    hash (if there is one), then its place."""
    return F.struct(date.isNull().alias("no_date"), date.alias("date"), row_id.isNull().alias("no_id"), row_id.alias("id"),
                    *([] if whole is None else [whole.alias("row")]), *place)


def first_of_group(df: DataFrame, date: str, row_id: str, unique_ids: bool = False) -> tuple[DataFrame, Column, str]:
    """(rows with a place column, order of a group's members, the place column): by date,
    then id, nulls last, then a hash of the whole row; among identical rows by place.
    ``unique_ids`` says that no two rows share their id (nulls share theirs): then the hash
    decides nothing, and neither it nor the columns it needs are read.
    The place is the row's position in the scan, so the rows should come from stored
    files, which every pass and every retry reads alike."""
    place = "_place"
    while place in df.columns:
        place += "_"
    placed = df.withColumn(place, F.monotonically_increasing_id())
    whole = None if unique_ids else row_hash(df)
    return placed, member_order(F.col(date), F.col(row_id), whole, F.col(place).alias("place")), place


def in_bounded_tasks(placed: DataFrame, group: str, order: Column) -> DataFrame:
    """(group, _order) of the rows of ``first_of_group``, dealt out by their place: an order with
    texts is aggregated by sorting, and a task here sorts a bounded part of the rows, not a
    whole file split. A hot group is still combined in each task before it is shuffled."""
    return placed.select(group, order.alias("_order")).repartition(F.col("_order.place"))


def flag_duplicates(df: DataFrame, first_seen_order=("metadata_originalPostingDate", "metadata_jobPostId"),
                    unique_ids: bool = False) -> DataFrame:
    """C-08: flag (not drop) same-day duplicates.

    dup_group_id is a hash of the typed key; the group size and the one first-seen
    member (``first_of_group``) come from ONE hash aggregation on the id -- map-side
    partial aggregation collapses a hot group to one row per input partition before
    the shuffle -- joined back on the id (AQE splits a skewed partition of that join).
    Shuffles carry the id as its 16 bytes, half of its text; the text is made after them."""
    d, j = first_seen_order
    placed, order, place = first_of_group(with_group_key(df), d, j, unique_ids)
    key = "_group"
    while key in placed.columns:
        key += "_"
    placed = placed.withColumn(key, F.unhex("dup_group_id"))
    groups = (in_bounded_tasks(placed, key, order).groupBy(key)
              .agg(F.count(F.lit(1)).cast("int").alias("dup_group_size"),
                   F.min("_order").getField("place").alias("_first")))
    flagged = (placed.drop("dup_group_id").join(groups, key)
               .withColumn("is_same_day_dup", F.col("dup_group_size") > 1)
               .withColumn("is_first_seen", F.col(place) == F.col("_first"))
               .drop("_first", place))
    return flagged.select(F.lower(F.hex(key)).alias("dup_group_id"), *[c for c in flagged.columns if c != key])


def rule_counts(df: DataFrame, id_col: str = "metadata_jobPostId") -> dict[str, Column]:
    """C-09: the violation count of every post-condition that holds row by row, as an
    aggregate: they fit into any pass over the rows, also as observed metrics of a write."""
    flag = F.col("salary_flag")
    lo, hi = F.col("salary_minimum"), F.col("salary_maximum")

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)), F.lit(0)).cast("long")

    def outside(x, a, b):
        return x.isNull() | (x < a) | (x > b)

    comparable = F.col("metadata_expiryDate").isNotNull() & F.col("metadata_newPostingDate").isNotNull()
    return {
        "title_not_null": n(F.col("title").isNull()),
        "no_synthetic": n(is_synthetic(id_col)),
        "ok_max_in_range": n((flag == "ok") & outside(hi, SALARY_FLOOR, SALARY_CEILING)),
        "ok_min_in_range": n((flag == "ok") & outside(lo, SALARY_FLOOR, SALARY_CEILING)),
        "stipend_in_range": n((flag == "low_stipend") & outside(hi, INTERN_STIPEND_FLOOR, SALARY_FLOOR)),
        "stipend_is_internship": n((flag == "low_stipend") & ~F.coalesce(F.col("employmentTypes") == INTERNSHIP_TYPE, F.lit(False))),
        "outlier_over_ceiling": n((flag == "outlier") & ~F.coalesce(hi > SALARY_CEILING, F.lit(False))),
        "outlier_not_null": n((flag == "outlier") & hi.isNull()),
        "undisclosed_equals_null": F.abs(n(flag == "undisclosed") - n(hi.isNull())),
        "paired_nulls": n(lo.isNull() != hi.isNull()),
        "expiry_after_posting": n(comparable & ~(F.col("metadata_expiryDate") > F.col("metadata_newPostingDate"))),
    }


def repeated_ids(df: DataFrame, id_col: str = "metadata_jobPostId") -> DataFrame:
    """C-09's rule over all rows: (rule, violations) with the rows that share their id (nulls
    share theirs) beyond the first of each. Reads the id column alone."""
    return (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.lit("unique_id").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations")))


def validate_rules(df: DataFrame, id_col: str = "metadata_jobPostId") -> DataFrame:
    """C-09: one row per post-condition with its violation count (0 = holds): the rules that
    hold row by row in one aggregation, the ids' uniqueness from the id column."""
    rules = rule_counts(df, id_col)
    wide = df.agg(*[v.alias(k) for k, v in rules.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in rules)
    return repeated_ids(df, id_col).unionByName(wide.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, violations)"))


def lossy_dates(cols=DATE_COLS) -> dict[str, Column]:
    """C-04: per date column the count of non-null texts that are no ``YYYY-MM-DD`` date, as
    an aggregate."""
    out = {}
    for c in cols:
        other = F.date_format(F.try_to_date(F.col(c), "yyyy-MM-dd"), "yyyy-MM-dd")
        bad = F.when(_plain_date(c), F.col(c).try_cast("date").isNull()).otherwise(F.col(c).isNotNull() & ~other.eqNullSafe(F.col(c)))
        out[c] = F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("long")
    return out


def int_range_check(df: DataFrame, widths: dict = INT_WIDTHS) -> DataFrame:
    """C-10: observed min/max of each integer column against its target width."""
    cols = [c for c in widths if c in df.columns]
    wide = df.agg(*[F.min(c).cast("long").alias(f"{c}__lo") for c in cols],
                  *[F.max(c).cast("long").alias(f"{c}__hi") for c in cols])
    stack = ", ".join(f"'{c}', {widths[c]}, `{c}__lo`, `{c}__hi`" for c in cols)
    out = wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, bits, observed_min, observed_max)")
    lim = F.pow(F.lit(2), F.col("bits") - 1)
    return out.withColumn("fits", F.coalesce((F.col("observed_min") >= -lim) & (F.col("observed_max") <= lim - 1), F.lit(True)))


def raise_on_violations(report: DataFrame, count_col: str = "violations", name_col: str = "rule") -> None:
    """Action: raise AssertionError listing every rule with a non-zero count."""
    bad = report.where(F.col(count_col) > 0).collect()
    if bad:
        raise AssertionError("; ".join(f"{r[name_col]}: {r[count_col]}" for r in bad))


def raise_on_counts(counts: dict[str, int]) -> None:
    """Raise AssertionError listing every name with a non-zero count."""
    bad = {k: n for k, n in counts.items() if n}
    if bad:
        raise AssertionError("; ".join(f"{k}: {n}" for k, n in bad.items()))


def clean_rows(df: DataFrame, prune: bool = False, watch=lambda step, rows: rows) -> DataFrame:
    """C-12 without the duplicate flags: every row cleaned on its own, in one pass without a
    shuffle. ``watch(step, rows)`` sees the rows after each step that removes some."""
    out = watch("ghost rows removed", remove_ghost_rows(watch("raw", df)))
    out = watch("synthetic rows removed", remove_synthetic_rows(out))
    if prune:
        out = prune_dead_columns(out)
    return add_derived_columns(normalize_text(cap_experience(fix_salaries(parse_categories(parse_dates(out))))))


def clean_dataset(df: DataFrame, prune: bool = False, check: bool = True):
    """C-12: the cleaning chain; returns ``(postings, bridge)``.

    ``check`` (the default) runs the date round trip and the validation rules as
    actions that raise; ``prune`` runs the dead-column scan (one small action)."""
    if check:
        raise_on_violations(date_roundtrip_check(df), "lossy_values", "column_name")
    out = flag_duplicates(clean_rows(df, prune))
    if check:
        raise_on_violations(validate_rules(out))
    return out, category_bridge(out)


def clean_stored(df: DataFrame, store, prune: bool = False, steps=None) -> DataFrame:
    """C-12 in one pass over ``df``: the rows are cleaned and written by ``store`` (rows ->
    the written rows) while that write counts, as observed metrics, the dates that are
    lost, the broken rules and the rows after each step (``steps``, a ``StepCounts``).
    Violations raise; then the duplicate flags come from narrow columns of what was
    written."""
    dates, rules = Observation(), Observation()
    watch = steps.watch if steps is not None else (lambda step, rows: rows)
    seen = df.observe(dates, *[n.alias(c) for c, n in lossy_dates().items()])
    rows = clean_rows(seen, prune, watch)
    written = store(rows.observe(rules, *[n.alias(r) for r, n in rule_counts(rows).items()]))
    raise_on_counts(dates.get | rules.get)
    raise_on_violations(repeated_ids(written))
    return flag_duplicates(written, unique_ids=True)  # repeated ids raised above
