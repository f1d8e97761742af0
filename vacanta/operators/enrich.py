"""Enrichment operators (cleaned postings -> the ``jobs`` fact).

All label/skill rules are ordered ``when``/``rlike`` chains evaluated in the
JVM; global statistics (p99 pay, max skill count) are a one-row aggregate
joined back with a broadcast of that single row.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, first_match, scalar
from ..functions.text import python_title

# ---- fixed values ------------------------------------------------------------
SKILLS = [
    "Python", "Java", "JavaScript", "SQL", "R", "C++", "Go", "Rust",
    "React", "Angular", "Vue", "Django", "Flask", "Spring",
    "AWS", "Azure", "GCP", "Kubernetes", "Docker",
    "Machine Learning", "AI", "Data Science", "Analytics",
    "Salesforce", "SAP", "Oracle", "MySQL", "PostgreSQL",
    "Agile", "Scrum", "DevOps", "CI/CD",
    "Node.js", "Express", "FastAPI",
]
NO_SKILLS = "Not Specified"

RENAME = {
    "metadata_jobPostId": "job_id",
    "postedCompany_name": "company",
    "primary_category": "sector",
    "salary_minimum": "salary_min",
    "salary_maximum": "salary_max",
    "average_salary": "salary_midpoint",
    "minimumYearsExperience": "seniority_years",
    "positionLevels": "position_level",
    "employmentTypes": "job_type",
    "metadata_originalPostingDate": "posting_date",
    "metadata_expiryDate": "expiry_date",
    "metadata_totalNumberOfView": "views",
    "metadata_totalNumberJobApplication": "applications",
    "numberOfVacancies": "vacancies",
    "metadata_repostCount": "repost_count",
}

JOBS_COLUMNS = [
    "job_id", "title", "company", "sector", "sub_sector",
    "salary_min", "salary_max", "experience_level",
    "seniority_years", "position_level", "job_type", "posting_date",
    "expiry_date", "views", "applications", "vacancies", "repost_count",
    "skills",
    "dup_group_id", "salary_midpoint", "salary_flag", "listing_days", "is_repost",
]
# Provenance and feature columns carried beside the fact columns.
EXTRA_COLUMNS = [
    "salary_band", "skill_count", "competitiveness_score", "job_label",
    "dup_group_size", "is_same_day_dup", "is_first_seen", "source", "n_categories",
    "metadata_newPostingDate", "metadata_isPostedOnBehalf", "status_jobStatus",
]

# Standard job labels: (title regex on the lower-cased title, label); first match wins.
JOB_LABEL_PATTERNS = [
    (r"\bdata engineer\b", "Data Engineer"),
    (r"\bdata analyst\b", "Data Analyst"),
    (r"\bdata scientist\b", "Data Scientist"),
    (r"\bsoftware engineer\b", "Software Engineer"),
    (r"\bsoftware developer\b", "Software Developer"),
    (r"\bproject manager\b", "Project Manager"),
    (r"\bsales executive\b", "Sales Executive"),
    (r"\baccounts executive\b", "Accounts Executive"),
    (r"\bquantity surveyor\b", "Quantity Surveyor"),
    (r"\b(retail|shop|store|floor) supervisor\b", "Retail Supervisor"),
    (r"\b(supervisor)\b.*\b(retail|shop|store|floor)\b", "Retail Supervisor"),
    (r"\b(restaurant|food and beverage|f&b|kitchen|cafe|bar|dining|hospitality) supervisor\b", "F&B Supervisor"),
    (r"\b(supervisor)\b.*\b(restaurant|food and beverage|f&b|kitchen|cafe|bar|dining|hospitality)\b", "F&B Supervisor"),
    (r"\b(construction|site|civil|building|contractor|foreman) supervisor\b", "Construction Supervisor"),
    (r"\b(supervisor)\b.*\b(construction|site|civil|building|contractor|foreman)\b", "Construction Supervisor"),
    (r"\b(officer|security|operations officer|shift officer) supervisor\b", "Officer Supervisor"),
    (r"\b(supervisor)\b.*\b(officer|security|operations officer|shift officer)\b", "Officer Supervisor"),
    (r"\bsupervisor\b", "Supervisor"),
    (r"\bchef\b", "Chef"),
    (r"\badmin(istrative)? assistant\b", "Administrative Assistant"),
    (r"\bmarketing executive\b", "Marketing Executive"),
    (r"\baccountant\b", "Accountant"),
    (r"\bbusiness analyst\b", "Business Analyst"),
]
# Supervisor titles: (title regex, company substrings, label); first match wins, else 'Supervisor'.
SUPERVISOR_PATTERNS = [
    (r"\b(retail|shop|store|floor|boutique)\b", ["retail"], "Retail Supervisor"),
    (r"\b(restaurant|food and beverage|f&b|kitchen|cafe|bar|dining|hospitality|hotel)\b", ["restaurant", "hotel"], "F&B Supervisor"),
    (r"\b(construction|site|civil|building|contractor|foreman|project site)\b", ["construction"], "Construction Supervisor"),
    (r"\b(security|operations|shift|officer|police|station)\b", ["security"], "Officer Supervisor"),
]
RANK_WORDS = r"\b(entry|mid|senior|lead|assistant|manager|executive|director|supervisor)\b"
PREFIX_LEVELS = ["Entry", "Mid", "Senior"]
# ------------------------------------------------------------------------------


def regex_escape(s: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", s)


def skill_pattern(skill: str) -> str:
    """Case-insensitive match with a non-alphanumeric boundary on both sides."""
    return "(?i)(?<![a-zA-Z0-9])" + regex_escape(skill) + "(?![a-zA-Z0-9])"


def band_experience(years) -> Column:
    """E-01: null Unknown, <=1 Entry Level, <=4 Mid Level, else Senior."""
    y = F.col(years) if isinstance(years, str) else years
    return first_match([(y.isNull(), "Unknown"), (y <= 1, "Entry Level"), (y <= 4, "Mid Level")], "Senior")


def band_salary(max_sal) -> Column:
    """E-02: banding on the salary maximum, strict upper bounds."""
    x = F.col(max_sal) if isinstance(max_sal, str) else max_sal
    return first_match([(x.isNull(), "Unknown"), (x < 3000, "Entry (< $3k)"),
                        (x < 5000, "Mid ($3-5k)"), (x < 8000, "Senior ($5-8k)")], "Executive (> $8k)")


def skill_hits(text) -> Column:
    """E-03: array of matched skills, in vocabulary order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_compact(F.array(*[F.when(t.rlike(skill_pattern(s)), F.lit(s)) for s in SKILLS]))


def skills_text(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.array_join(hits, ", ")).otherwise(F.lit(NO_SKILLS))


def extract_skills(df: DataFrame, text: str = "title") -> DataFrame:
    """E-03 as an operator: adds ``skills`` ("A, B" or Not Specified) and ``skill_count``."""
    hits = skill_hits(F.coalesce(F.col(text), F.lit("")))
    return (df.withColumn("_hits", hits)
            .withColumn("skills", skills_text(F.col("_hits")))
            .withColumn("skill_count", F.size("_hits").cast("int"))
            .drop("_hits"))


def _supervisor_label(lookup: Column, company_hint: Column | None) -> Column:
    rules = []
    for pat, hints, label in SUPERVISOR_PATTERNS:
        cond = lookup.rlike(pat)
        if company_hint is not None:
            for h in hints:
                cond = cond | company_hint.contains(h)
        rules.append((cond, label))
    return first_match(rules, "Supervisor")


def title_label(title) -> Column:
    """The part of E-04 that hangs on the title alone."""
    title_text = F.trim(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    lookup = F.lower(title_text)
    return first_match([(lookup.rlike(p), lbl) for p, lbl in JOB_LABEL_PATTERNS],
                       F.when(title_text != "", python_title(title_text)).otherwise(F.lit("Unknown")))


def job_label(title, position_level=None, company=None, base: Column | None = None) -> Column:
    """E-04: standard job label from title, position level and company; ``base`` is the
    title's own label where it is at hand (``title_label``)."""
    t = F.col(title) if isinstance(title, str) else title
    title_text = F.trim(F.coalesce(t, F.lit("")))
    lookup = F.lower(title_text)
    hint = F.lower(F.trim(F.coalesce(F.col(company), F.lit("")))) if company else F.lit("")
    base = title_label(title) if base is None else base
    if company:
        base = first_match([(hint.contains("retail") & lookup.contains("assistant"), "Retail Assistant"),
                            (hint.contains("bank") & lookup.contains("executive"), "Banking Executive")], base)
    if position_level:
        lvl = F.trim(F.coalesce(F.col(position_level), F.lit("")))
        prefix = F.when(lvl.isin(PREFIX_LEVELS) & ~lookup.rlike(RANK_WORDS), F.concat(lvl, F.lit(" "))).otherwise(F.lit(""))
        base = F.concat(prefix, base)
    return F.when(lookup.contains("supervisor"), _supervisor_label(lookup, hint if company else None)).otherwise(base)


def job_label_title(title) -> Column:
    """E-05: title-only label (no company hints, no level prefix)."""
    return job_label(title)


def label_distinct_titles(df: DataFrame, title: str = "title", out: str = "job_label") -> DataFrame:
    """E-05 as a join: label each distinct title once, then left-join back on title.
    The label table has one row per distinct title; the planner broadcasts it
    only when its measured size is under the broadcast threshold."""
    labels = df.select(title).where(F.col(title).isNotNull()).distinct().withColumn(out, job_label_title(title))
    return (df.join(labels, title, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit("Unknown"))))


def title_features(df: DataFrame, title: str = "title") -> DataFrame:
    """E-03 / E-05 once per distinct title: (title, skills, skill_count, title_label). The
    pattern lists run over the titles in use, not over the postings."""
    return extract_skills(df.select(title).distinct(), title).withColumn("title_label", title_label(title))


def competitiveness(df: DataFrame, mid: str = "salary_midpoint", skills: str = "skill_count",
                    flag: str = "salary_flag", approx: bool = False, pay_from: DataFrame | None = None,
                    skills_from: DataFrame | None = None) -> DataFrame:
    """E-07: min(50, midpoint / p99(ok midpoints) * 50) (null -> 25) plus
    skill_count / max(skill_count, 1) * 50, clipped to 0..100.

    The two global statistics are single-row aggregates read back as scalar
    subqueries (computed once, no join), over ``pay_from`` and ``skills_from`` if
    these hold the same values in fewer rows or columns."""
    basis = F.when(F.col(flag) == "ok", F.col(mid)) if flag in df.columns else F.col(mid)
    p99 = F.percentile_approx(basis, 0.99, 10000) if approx else F.percentile(basis, F.lit(0.99))
    high_pay = (df if pay_from is None else pay_from).agg(p99.cast("double").alias("_p99"))
    most = (df if skills_from is None else skills_from).agg(
        F.greatest(F.coalesce(F.max(skills), F.lit(0)), F.lit(1)).alias("_smax"))
    pay = clip(F.try_divide(F.col(mid), scalar(high_pay, "_p99")) * 50, hi=50.0)
    score = F.coalesce(pay, F.lit(25.0)) + F.col(skills) / scalar(most, "_smax") * 50
    return df.withColumn("competitiveness_score", clip(score.cast("double"), 0.0, 100.0))


def feature_enrichment(clean: DataFrame, bridge: DataFrame | None = None, store=None) -> DataFrame:
    """E-08: rename to the fact names and derive the feature columns.

    ``store`` (rows -> the written rows) keeps the features of the titles, so that the
    planner knows their bytes: few titles are broadcast and the postings stay where they
    are, instead of being dealt out by title, a few of which hold most postings.

    ``sub_sector`` is the second category of the posting's own (typed) list;
    passing the bridge instead reads it from the bridge row at position 1."""
    out = clean.withColumnsRenamed(RENAME)
    if bridge is not None:
        second = bridge.where(F.col("pos") == 1).select(
            F.col("metadata_jobPostId").alias("job_id"), F.col("category").alias("sub_sector"))
        out = out.join(second, "job_id", "left")
    else:
        out = out.withColumn("sub_sector", F.get(F.col("categories"), 1).getField("category"))
    out = out.withColumns({
        "experience_level": band_experience("seniority_years"),
        "salary_band": band_salary("salary_max"),
    })
    out = out.withColumn("seniority_years", F.coalesce(F.col("seniority_years"), F.lit(0)).cast("int"))
    titles = title_features(out)
    titles = store(titles) if store else titles
    plain = out
    own = titles.withColumnRenamed("title", "_title")
    out = out.join(own, out["title"].eqNullSafe(own["_title"]), "left").drop("_title")
    out = competitiveness(out, pay_from=plain, skills_from=titles)
    out = out.withColumn("job_label", job_label("title", "position_level", "company", base=F.col("title_label")))
    return out.select(*JOBS_COLUMNS, *[c for c in EXTRA_COLUMNS if c in out.columns])


def schema_report(df: DataFrame, expected=JOBS_COLUMNS) -> DataFrame:
    """E-09 / U-04: columns missing from / extra to the fact schema, as set
    differences of the column lists (metadata only, no data is read)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [("missing", c) for c in expected if c not in df.columns] + \
           [("extra", c) for c in df.columns if c not in expected]
    return spark.createDataFrame(rows, "kind string, column_name string")


#: Derived columns of little value (E-10): title keywords stand in for a text that the source
#: lacks, and the score does not follow its own inputs. No contract column is among them.
LOW_VALUE_COLUMNS = ["skill_count", "competitiveness_score"]


def prune_low_value(jobs: DataFrame, columns=LOW_VALUE_COLUMNS, contract=JOBS_COLUMNS) -> DataFrame:
    """E-10: ``jobs`` without the columns that the value report found of little use; one that
    the fact's contract names, or that is not there, raises."""
    kept = [c for c in columns if c in contract]
    absent = [c for c in columns if c not in jobs.columns]
    if kept or absent:
        raise ValueError(f"cannot prune contract columns {kept} or absent columns {absent}")
    return jobs.drop(*columns)
