"""Raw posting binding: the driver's order tables seen as a raw job-posting extract.

One order with at least one line item is one posting. The per-order line
aggregate is a map-side-combined ``groupBy`` on the order key; the dimension
lookups are equi-joins that the planner broadcasts when (and only when) the
dimension's measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
Defects (ghost rows, synthetic ids, placeholder salaries, impossible years,
zero-width characters, same-day copies) are injected by key arithmetic so the
cleaning operators have something to remove. Only integer arithmetic and
``floor`` are used, so the DuckDB oracle reproduces the rows exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import scan

# ---- fixed values of the binding -------------------------------------------
# Title by (min part key) % 8, in this order.
TITLES = [
    "Data Engineer  (Python/SQL)",
    "retail supervisor",
    "C++ Software Engineer",
    "Security Officer",
    "ACCOUNTANT",
    "Barista",
    "Cleaner",
    "DevOps Engineer, AWS",
]
# Category (id, name) by part type.
SECTOR_BY_PART_TYPE = {
    "ECONOMY": (1, "F&B"),
    "LARGE": (2, "Engineering"),
    "MEDIUM": (3, "Information Technology"),
    "PROMO": (4, "Sales / Retail"),
    "SMALL": (5, "General Work"),
    "STANDARD": (6, "Security and Investigation"),
}
SECOND_CATEGORY = (7, "Others")
# Employment type by customer market segment.
EMPLOYMENT_BY_SEGMENT = {
    "AUTOMOBILE": "Permanent",
    "BUILDING": "Full Time",
    "FURNITURE": "Contract",
    "HOUSEHOLD": "Temporary",
    "MACHINERY": "Internship/Attachment",
}
# Position level by order priority digit 1..5.
LEVEL_BY_PRIORITY = ["Manager", "Professional", "Executive", "Junior Executive", "Non-executive"]
ZERO_WIDTH_PREFIX = "\u200b  "
# -----------------------------------------------------------------------------

RAW_COLUMNS = [
    "categories", "employmentTypes", "metadata_expiryDate", "metadata_isPostedOnBehalf",
    "metadata_jobPostId", "metadata_newPostingDate", "metadata_originalPostingDate",
    "metadata_repostCount", "metadata_totalNumberJobApplication", "metadata_totalNumberOfView",
    "minimumYearsExperience", "numberOfVacancies", "occupationId", "positionLevels",
    "postedCompany_name", "salary_maximum", "salary_minimum", "salary_type", "status_id",
    "status_jobStatus", "title", "average_salary",
]


def _lookup(key: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def _category_json(cid: Column, name: Column) -> Column:
    return F.concat(F.lit('{"id": '), cid.cast("string"), F.lit(', "category": "'), name, F.lit('"}'))


def posting_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to their line aggregate and dimensions; one row per order."""
    lines = (scan(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
             .groupBy("l_orderkey")
             .agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"),
                  F.count(F.lit(1)).alias("nl"),
                  F.floor(F.sum("l_quantity")).alias("qty")))
    orders = scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                  "o_orderdate", "o_orderpriority")
    part = scan(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    supplier = scan(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    customer = scan(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return (orders.join(lines, orders.o_orderkey == lines.l_orderkey)
            .join(part, F.col("pk") == part.p_partkey)
            .join(supplier, F.col("sk") == supplier.s_suppkey)
            .join(customer, orders.o_custkey == customer.c_custkey)
            .select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("od"),
                    F.col("o_totalprice").alias("tp"), F.col("o_orderpriority").alias("pri"),
                    "nl", "qty", "p_partkey", "p_type", "p_size", "s_name", "c_mktsegment"))


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22-column raw posting extract (typed as a CSV reader would type it)."""
    b = posting_base(spark, sf_dir)
    k = F.col("k")
    b = b.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(k % 20 == 1, 2).otherwise(1))))
    ghost = (k % 500 == 7)

    def text(c: Column) -> Column:
        return F.when(ghost, F.lit(None).cast("string")).otherwise(c)

    def num(c: Column, t: str = "int") -> Column:
        return F.when(ghost, F.lit(0).cast(t)).otherwise(c.cast(t))

    sector_id = _lookup(F.col("p_type"), {t: v[0] for t, v in SECTOR_BY_PART_TYPE.items()})
    sector = _lookup(F.col("p_type"), {t: v[1] for t, v in SECTOR_BY_PART_TYPE.items()})
    first = _category_json(sector_id, sector)
    second = _category_json(F.lit(SECOND_CATEGORY[0]), F.lit(SECOND_CATEGORY[1]))
    categories = (F.when(k % 211 == 0, F.lit("[]"))
                  .when(k % 3 == 0, F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]")))
                  .otherwise(F.concat(F.lit("["), first, F.lit("]"))))
    base_title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    title = F.when(k % 13 == 0, F.concat(F.lit(ZERO_WIDTH_PREFIX), base_title)).otherwise(base_title)
    company = F.when(k % 29 == 0, F.concat(F.lower("s_name"), F.lit("  Recruit"))).otherwise(F.col("s_name"))
    ident = (F.when(k % 997 == 0, F.concat(F.lit("RANDOM_JOB_"), k.cast("string")))
             .when(k % 11 == 0, F.concat(F.lit("ATS-"), k.cast("string"), F.lit("-"), F.col("copy").cast("string")))
             .otherwise(F.concat(F.lit("MCF-"), k.cast("string"), F.lit("-"), F.col("copy").cast("string"))))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVEL_BY_PRIORITY]),
                         F.substring("pri", 1, 1).cast("int"))
    smin0 = F.floor(F.col("tp") / 50)
    smax0 = smin0 + F.floor(F.col("tp") / 200)
    smin = F.when(k % 97 == 0, F.lit(1)).otherwise(smin0).cast("int")
    smax = F.when(k % 97 == 0, F.lit(1)).when(k % 400 == 3, F.lit(150000)).otherwise(smax0).cast("int")
    years = F.when(k % 333 == 0, F.lit(150)).otherwise(F.col("p_size") % 12)
    repost = F.when((k + F.col("p_size")) % 6 == 0, 1 + k % 2).otherwise(F.lit(0)).cast("int")
    new_date = F.date_add("od", repost * 10)
    expiry = F.date_add(new_date, F.when(k % 5 == 0, 7).otherwise(30))
    status = F.element_at(F.array(F.lit("Open"), F.lit("Closed"), F.lit("Re-open")), (k % 3 + 1).cast("int"))

    def ymd(c: Column) -> Column:
        return F.date_format(c, "yyyy-MM-dd")

    return b.select(
        text(categories).alias("categories"),
        text(_lookup(F.col("c_mktsegment"), EMPLOYMENT_BY_SEGMENT)).alias("employmentTypes"),
        text(ymd(expiry)).alias("metadata_expiryDate"),
        (k % 17 == 0).alias("metadata_isPostedOnBehalf"),
        text(ident).alias("metadata_jobPostId"),
        text(ymd(new_date)).alias("metadata_newPostingDate"),
        text(ymd(F.col("od"))).alias("metadata_originalPostingDate"),
        num(repost).alias("metadata_repostCount"),
        num(F.floor(F.col("qty") / 8)).alias("metadata_totalNumberJobApplication"),
        num(F.col("qty") + F.col("copy") - 1).alias("metadata_totalNumberOfView"),
        num(years).alias("minimumYearsExperience"),
        num(F.col("nl")).alias("numberOfVacancies"),
        F.lit(None).cast("string").alias("occupationId"),
        text(level).alias("positionLevels"),
        text(company).alias("postedCompany_name"),
        num(smax).alias("salary_maximum"),
        num(smin).alias("salary_minimum"),
        text(F.lit("Monthly")).alias("salary_type"),
        num(F.lit(0)).alias("status_id"),
        text(status).alias("status_jobStatus"),
        text(title).alias("title"),
        num((smin + smax) / 2.0, "double").alias("average_salary"),
    )
