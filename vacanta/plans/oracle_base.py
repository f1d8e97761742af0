"""DuckDB SQL fragments shared by the oracles.

Each oracle is an independent re-statement, in plain SQL over the
pre-registered input views, of what the Spark operators compute: the raw
binding, cleaning, enrichment and dedup are re-derived here as CTEs, never
read from anything Spark wrote.
"""
from __future__ import annotations

from ..sources.bind import (EMPLOYMENT_BY_SEGMENT, LEVEL_BY_PRIORITY, SECOND_CATEGORY,
                            SECTOR_BY_PART_TYPE, TITLES, ZERO_WIDTH_PREFIX)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(key: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {_q(k)} THEN {_q(str(v))}" for k, v in mapping.items()) + " END"


_SECTOR_ID = "CASE " + " ".join(f"WHEN p_type = {_q(t)} THEN {v[0]}" for t, v in SECTOR_BY_PART_TYPE.items()) + " END"
_SECTOR = _case("p_type", {t: v[1] for t, v in SECTOR_BY_PART_TYPE.items()})
_FIRST = "'{\"id\": ' || CAST(" + _SECTOR_ID + " AS VARCHAR) || ', \"category\": \"' || " + _SECTOR + " || '\"}'"
_SECOND = _q('{"id": %d, "category": "%s"}' % SECOND_CATEGORY)
_TITLE = "(" + _q("") + " || [" + ", ".join(_q(t) for t in TITLES) + "][p_partkey % 8 + 1])"
_LEVEL = "[" + ", ".join(_q(x) for x in LEVEL_BY_PRIORITY) + "][CAST(substr(pri, 1, 1) AS INTEGER)]"

BIND = f"""
b_lines AS (
    SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk, count(*) AS nl,
           floor(sum(l_quantity)) AS qty
    FROM lineitem GROUP BY l_orderkey
),
b_base AS (
    SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS od, o.o_totalprice AS tp,
           o.o_orderpriority AS pri, l.nl, l.qty, p.p_partkey, p.p_type, p.p_size, s.s_name, c.c_mktsegment
    FROM orders o
    JOIN b_lines l ON l.l_orderkey = o.o_orderkey
    JOIN part p ON p.p_partkey = l.pk
    JOIN supplier s ON s.s_suppkey = l.sk
    JOIN customer c ON c.c_custkey = o.o_custkey
),
b_copies AS (
    SELECT *, 1 AS copy FROM b_base
    UNION ALL
    SELECT *, 2 AS copy FROM b_base WHERE k % 20 = 1
),
b_vals AS (
    SELECT *, k % 500 = 7 AS ghost,
        CASE WHEN k % 97 = 0 THEN 1 ELSE CAST(floor(tp / 50) AS INTEGER) END AS smin,
        CASE WHEN k % 97 = 0 THEN 1 WHEN k % 400 = 3 THEN 150000
             ELSE CAST(floor(tp / 50) + floor(tp / 200) AS INTEGER) END AS smax,
        CAST(CASE WHEN (k + p_size) % 6 = 0 THEN 1 + k % 2 ELSE 0 END AS INTEGER) AS repost
    FROM b_copies
),
b_dates AS (
    SELECT *, od + CAST(repost * 10 AS INTEGER) AS new_date FROM b_vals
),
raw AS (
    SELECT
        CASE WHEN ghost THEN NULL
             WHEN k % 211 = 0 THEN '[]'
             WHEN k % 3 = 0 THEN '[' || {_FIRST} || ', ' || {_SECOND} || ']'
             ELSE '[' || {_FIRST} || ']' END AS categories,
        CASE WHEN ghost THEN NULL ELSE {_case("c_mktsegment", EMPLOYMENT_BY_SEGMENT)} END AS employmentTypes,
        CASE WHEN ghost THEN NULL ELSE strftime(new_date + CAST(CASE WHEN k % 5 = 0 THEN 7 ELSE 30 END AS INTEGER), '%Y-%m-%d') END AS metadata_expiryDate,
        k % 17 = 0 AS metadata_isPostedOnBehalf,
        CASE WHEN ghost THEN NULL
             WHEN k % 997 = 0 THEN 'RANDOM_JOB_' || CAST(k AS VARCHAR)
             WHEN k % 11 = 0 THEN 'ATS-' || CAST(k AS VARCHAR) || '-' || CAST(copy AS VARCHAR)
             ELSE 'MCF-' || CAST(k AS VARCHAR) || '-' || CAST(copy AS VARCHAR) END AS metadata_jobPostId,
        CASE WHEN ghost THEN NULL ELSE strftime(new_date, '%Y-%m-%d') END AS metadata_newPostingDate,
        CASE WHEN ghost THEN NULL ELSE strftime(od, '%Y-%m-%d') END AS metadata_originalPostingDate,
        CASE WHEN ghost THEN 0 ELSE repost END AS metadata_repostCount,
        CASE WHEN ghost THEN 0 ELSE CAST(floor(qty / 8) AS INTEGER) END AS metadata_totalNumberJobApplication,
        CASE WHEN ghost THEN 0 ELSE CAST(qty + copy - 1 AS INTEGER) END AS metadata_totalNumberOfView,
        CASE WHEN ghost THEN 0 WHEN k % 333 = 0 THEN 150 ELSE CAST(p_size % 12 AS INTEGER) END AS minimumYearsExperience,
        CASE WHEN ghost THEN 0 ELSE CAST(nl AS INTEGER) END AS numberOfVacancies,
        CAST(NULL AS VARCHAR) AS occupationId,
        CASE WHEN ghost THEN NULL ELSE {_LEVEL} END AS positionLevels,
        CASE WHEN ghost THEN NULL WHEN k % 29 = 0 THEN lower(s_name) || '  Recruit' ELSE s_name END AS postedCompany_name,
        CASE WHEN ghost THEN 0 ELSE smax END AS salary_maximum,
        CASE WHEN ghost THEN 0 ELSE smin END AS salary_minimum,
        CASE WHEN ghost THEN NULL ELSE 'Monthly' END AS salary_type,
        0 AS status_id,
        CASE WHEN ghost THEN NULL ELSE ['Open', 'Closed', 'Re-open'][k % 3 + 1] END AS status_jobStatus,
        CASE WHEN ghost THEN NULL
             WHEN k % 13 = 0 THEN {_q(ZERO_WIDTH_PREFIX)} || {_TITLE}
             ELSE {_TITLE} END AS title,
        CASE WHEN ghost THEN 0.0 ELSE (smin + smax) / 2.0 END AS average_salary
    FROM b_dates
)"""


# ---- SQL twins of the column helpers -----------------------------------------
from ..operators import clean as _C  # noqa: E402
from ..operators import enrich as _E  # noqa: E402

_INVISIBLE = "[\\x{200B}\\x{200E}\\x{200F}\\x{2060}\\x{FEFF}]"


def sql_repair(e: str) -> str:
    from ..functions.text import WHITESPACE_CLASS
    return f"trim(regexp_replace(regexp_replace({e}, '{_INVISIBLE}', '', 'g'), '{WHITESPACE_CLASS}+', ' ', 'g'))"


def sql_py_strip(e: str) -> str:
    from ..functions.text import WHITESPACE_CLASS
    return f"regexp_replace({e}, '^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$', '', 'g')"


def sql_title(e: str) -> str:
    return (f"array_to_string(list_transform(range(1, length({e}) + 1), lambda i: CASE WHEN i > 1 AND "
            f"regexp_matches(substring({e}, i - 1, 1), '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]') "
            f"THEN lower(substring({e}, i, 1)) ELSE upper(substring({e}, i, 1)) END), '')")


def _sql_regex_literal(p: str) -> str:
    return _q(p)


def sql_skill_list(t: str) -> str:
    parts = []
    for s in _E.SKILLS:
        pat = "(^|[^a-zA-Z0-9])" + _E.regex_escape(s) + "($|[^a-zA-Z0-9])"
        parts.append(f"CASE WHEN regexp_matches({t}, {_q(pat)}, 'i') THEN {_q(s)} END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def sql_job_label(title: str, level: str | None = None, company: str | None = None) -> str:
    tt = f"trim(coalesce({title}, ''))"
    lk = f"lower({tt})"
    hint = f"lower(trim(coalesce({company}, '')))" if company else "''"
    base = "CASE " + " ".join(f"WHEN regexp_matches({lk}, {_q(p)}) THEN {_q(l)}" for p, l in _E.JOB_LABEL_PATTERNS)
    base += f" WHEN {tt} <> '' THEN {sql_title(tt)} ELSE 'Unknown' END"
    if company:
        base = (f"CASE WHEN contains({hint}, 'retail') AND contains({lk}, 'assistant') THEN 'Retail Assistant' "
                f"WHEN contains({hint}, 'bank') AND contains({lk}, 'executive') THEN 'Banking Executive' ELSE {base} END")
    if level:
        lv = f"trim(coalesce({level}, ''))"
        levels = ", ".join(_q(x) for x in _E.PREFIX_LEVELS)
        base = (f"CASE WHEN {lv} IN ({levels}) AND NOT regexp_matches({lk}, {_q(_E.RANK_WORDS)}) "
                f"THEN {lv} || ' ' || ({base}) ELSE {base} END")
    sup = "CASE "
    for pat, hints, label in _E.SUPERVISOR_PATTERNS:
        cond = f"regexp_matches({lk}, {_q(pat)})"
        if company:
            cond += "".join(f" OR contains({hint}, {_q(h)})" for h in hints)
        sup += f"WHEN {cond} THEN {_q(label)} "
    sup += "ELSE 'Supervisor' END"
    return f"CASE WHEN contains({lk}, 'supervisor') THEN {sup} ELSE {base} END"


_RAW_TEXT = ["categories", "employmentTypes", "metadata_expiryDate", "metadata_jobPostId",
             "metadata_newPostingDate", "metadata_originalPostingDate", "occupationId", "positionLevels",
             "postedCompany_name", "salary_type", "status_jobStatus", "title"]
_RAW_NUM = ["metadata_repostCount", "metadata_totalNumberJobApplication", "metadata_totalNumberOfView",
            "minimumYearsExperience", "numberOfVacancies", "salary_maximum", "salary_minimum", "status_id",
            "average_salary"]
GHOST_SQL = " AND ".join([f"{c} IS NULL" for c in _RAW_TEXT] + [f"coalesce({c}, 0) = 0" for c in _RAW_NUM])


def _key_text(e: str) -> str:
    return f"coalesce(CAST(length(CAST({e} AS VARCHAR)) AS VARCHAR) || ':' || CAST({e} AS VARCHAR), '-')"


_DUP_PARTS = ", ".join(_key_text("lower(title)" if c == "title" else c) for c in _C.DUP_KEY)

CLEAN = f"""
c_kept AS (
    SELECT * FROM raw
    WHERE NOT ({GHOST_SQL})
      AND NOT coalesce(regexp_matches(metadata_jobPostId, '^RANDOM_JOB_'), false)
),
c_typed AS (
    SELECT * REPLACE (
        TRY_CAST(metadata_newPostingDate AS DATE) AS metadata_newPostingDate,
        TRY_CAST(metadata_originalPostingDate AS DATE) AS metadata_originalPostingDate,
        TRY_CAST(metadata_expiryDate AS DATE) AS metadata_expiryDate,
        coalesce(from_json(categories, '[{{"id":"INTEGER","category":"VARCHAR"}}]'), []) AS categories)
    FROM c_kept
),
c_sal AS (
    SELECT *,
        coalesce(salary_minimum < 500, true) AS low_min,
        coalesce(salary_maximum < 500, true) AS low_max,
        coalesce(salary_maximum > 100000, false) AS high_max,
        coalesce(employmentTypes = 'Internship/Attachment', false)
          AND coalesce(salary_minimum < 500, true) AND coalesce(salary_maximum < 500, true)
          AND coalesce(salary_minimum >= 300, false) AND coalesce(salary_maximum >= 300, false) AS stipend
    FROM c_typed
),
c_fixed AS (
    SELECT * EXCLUDE (low_min, low_max, high_max, stipend) REPLACE (
        CASE WHEN (low_min OR low_max) AND NOT stipend THEN NULL ELSE salary_minimum END AS salary_minimum,
        CASE WHEN (low_min OR low_max) AND NOT stipend THEN NULL ELSE salary_maximum END AS salary_maximum,
        CASE WHEN coalesce(minimumYearsExperience > 100, false) THEN NULL ELSE minimumYearsExperience END AS minimumYearsExperience,
        {sql_title(sql_repair("title"))} AS title,
        {sql_repair("upper(postedCompany_name)")} AS postedCompany_name),
        CASE WHEN (low_min OR low_max) AND NOT stipend THEN 'undisclosed' WHEN stipend THEN 'low_stipend'
             WHEN high_max THEN 'outlier' ELSE 'ok' END AS salary_flag,
        categories[1].category AS primary_category,
        CAST(len(categories) AS INTEGER) AS n_categories
    FROM c_sal
),
c_derived AS (
    SELECT * REPLACE ((salary_minimum + salary_maximum) / 2.0 AS average_salary),
        CAST(date_diff('day', metadata_newPostingDate, metadata_expiryDate) AS INTEGER) AS listing_days,
        metadata_repostCount > 0 AS is_repost,
        nullif(regexp_extract(metadata_jobPostId, '^([A-Za-z]+)', 1), '') AS source,
        md5(concat_ws('|', {_DUP_PARTS})) AS dup_group_id
    FROM c_fixed
),
clean AS (
    SELECT *,
        CAST(count(*) OVER (PARTITION BY dup_group_id) AS INTEGER) AS dup_group_size,
        count(*) OVER (PARTITION BY dup_group_id) > 1 AS is_same_day_dup,
        row_number() OVER (PARTITION BY dup_group_id ORDER BY metadata_originalPostingDate NULLS LAST,
                           metadata_jobPostId) = 1 AS is_first_seen
    FROM c_derived
)"""

_RENAME_SQL = ", ".join(f"{src} AS {dst}" for src, dst in _E.RENAME.items())
_JOB_OUT = ", ".join(_E.JOBS_COLUMNS + _E.EXTRA_COLUMNS)

JOBS = f"""
j_renamed AS (
    SELECT *, {_RENAME_SQL}, categories[2].category AS sub_sector FROM clean
),
j_feat AS (
    SELECT * REPLACE (CAST(coalesce(seniority_years, 0) AS INTEGER) AS seniority_years),
        CASE WHEN seniority_years IS NULL THEN 'Unknown' WHEN seniority_years <= 1 THEN 'Entry Level'
             WHEN seniority_years <= 4 THEN 'Mid Level' ELSE 'Senior' END AS experience_level,
        CASE WHEN salary_max IS NULL THEN 'Unknown' WHEN salary_max < 3000 THEN 'Entry (< $3k)'
             WHEN salary_max < 5000 THEN 'Mid ($3-5k)' WHEN salary_max < 8000 THEN 'Senior ($5-8k)'
             ELSE 'Executive (> $8k)' END AS salary_band,
        {sql_skill_list("coalesce(title, '')")} AS skill_list,
        {sql_job_label("title", "position_level", "company")} AS job_label
    FROM j_renamed
),
j_skills AS (
    SELECT *, CASE WHEN len(skill_list) > 0 THEN array_to_string(skill_list, ', ') ELSE 'Not Specified' END AS skills,
           CAST(len(skill_list) AS INTEGER) AS skill_count
    FROM j_feat
),
j_stats AS (
    SELECT quantile_cont(salary_midpoint, 0.99) FILTER (WHERE salary_flag = 'ok') AS p99,
           greatest(coalesce(max(skill_count), 0), 1) AS smax
    FROM j_skills
),
j_scored AS (
    SELECT s.*,
        coalesce(CASE WHEN salary_midpoint / nullif(p99, 0) * 50 IS NOT NULL
                      THEN least(salary_midpoint / nullif(p99, 0) * 50, 50.0) END, 25.0)
          + skill_count / smax * 50 AS raw_score
    FROM j_skills s, j_stats
),
jobs AS (
    SELECT * REPLACE (CASE WHEN raw_score IS NOT NULL THEN least(greatest(raw_score, 0.0), 100.0) END AS competitiveness_score)
    FROM (SELECT *, raw_score AS competitiveness_score FROM j_scored)
),
deduped AS (
    SELECT * FROM jobs WHERE is_first_seen
)"""


def with_ctes(*fragments: str, body: str) -> str:
    return "WITH " + ",\n".join(f.strip() for f in fragments) + "\n" + body


def on_jobs(body: str) -> str:
    """SQL over the binding -> clean -> jobs -> deduped chain."""
    return with_ctes(BIND, CLEAN, JOBS, body=body)


JOB_COLUMNS_SQL = _JOB_OUT


# ---- finance fact ----------------------------------------------------------------
from ..operators import finance as _P  # noqa: E402


def _rules_case(expr: str, rules, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def sql_cohort(jt: str) -> str:
    t = f"lower(coalesce({jt}, ''))"
    return _rules_case(t, [(f"regexp_matches({t}, {_q(_P.PERMANENT_PATTERN)})", "'Permanent'"),
                           (f"regexp_matches({t}, {_q(_P.CONTRACT_PATTERN)})", "'Contract'")], "'Other'")


def sql_recruitment_type(et: str) -> str:
    t = f"lower(coalesce({et}, ''))"
    return _rules_case(t, [(f"regexp_matches({t}, {_q(p)})", _q(l)) for l, p in _P.RECRUITMENT_RULES], "'Other'")


def sql_cost_columns(src: str, s=_P.DEFAULT) -> str:
    """SELECT list re-deriving the cost columns of ``src`` (which has the
    planning salary, cohort, vacancies and window)."""
    return f"""(
    SELECT *,
        loaded_monthly_cost_per_head * number_of_vacancies AS loaded_monthly_cost_for_vacancies,
        loaded_monthly_cost_per_head * number_of_vacancies / {s.days_per_month!r} AS daily_loaded_cost_for_vacancies,
        loaded_monthly_cost_per_head * number_of_vacancies / {s.days_per_month!r} * posting_window_days AS vacancy_budget_exposure,
        (loaded_monthly_cost_per_head * number_of_vacancies / {s.days_per_month!r} * posting_window_days) / nullif(number_of_vacancies, 0) AS vacancy_exposure_per_opening
    FROM (
        SELECT *, planning_salary_midpoint_monthly * total_cost_multiplier AS loaded_monthly_cost_per_head
        FROM (
            SELECT *, 1.0 + employer_burden_rate + agency_premium_rate AS total_cost_multiplier
            FROM (
                SELECT *,
                    CAST(CASE WHEN employment_cohort = 'Permanent' THEN {s.permanent_employer_burden_rate!r}
                         WHEN employment_cohort = 'Contract' THEN {s.contract_employer_burden_rate!r} ELSE 0.0 END AS DOUBLE) AS employer_burden_rate,
                    CAST(CASE WHEN employment_cohort = 'Contract' THEN {s.contract_agency_premium_rate!r} ELSE 0.0 END AS DOUBLE) AS agency_premium_rate
                FROM {src}))))"""


_PWM = _rules_case("", [(f"regexp_matches(title, {_q('(?i)' + pat)}) AND sector IN ({', '.join(_q(i) for i in inds)})", _q(lbl))
                        for lbl, pat, inds in _P.PWM_RULES])
_Q = _P.DEFAULT.salary_planning_cap_quantile

FIN = f"""
f_base AS (
    SELECT job_id, title, company, coalesce(sector, 'Unclassified') AS sector,
        coalesce(sub_sector, 'Unspecified') AS sub_sector, position_level, job_type AS employment_type,
        salary_min AS salary_minimum, salary_max AS salary_maximum,
        (salary_min + salary_max) / 2.0 AS salary_midpoint_monthly, 'Monthly' AS salary_type,
        posting_date, expiry_date, coalesce(vacancies, 0) AS number_of_vacancies, repost_count,
        CASE WHEN expiry_date IS NOT NULL AND posting_date IS NOT NULL
             THEN greatest(CAST(date_diff('day', posting_date, expiry_date) AS INTEGER), 0) END AS posting_window_days,
        CAST(NULL AS INTEGER) AS new_posting_lag_days,
        {sql_cohort("job_type")} AS employment_cohort, skills
    FROM jobs
),
f_bounds AS (
    SELECT quantile_cont(salary_midpoint_monthly, {1 - _Q!r}) AS fl, quantile_cont(salary_midpoint_monthly, {_Q!r}) AS cp
    FROM f_base
),
f_planned AS (
    SELECT b.*,
        coalesce(salary_midpoint_monthly < fl, false) AS salary_low_outlier_flag,
        coalesce(salary_midpoint_monthly > cp, false) AS salary_high_outlier_flag,
        CASE WHEN salary_midpoint_monthly IS NOT NULL THEN least(greatest(salary_midpoint_monthly, fl), cp) END
            AS planning_salary_midpoint_monthly
    FROM f_base b, f_bounds
),
f_costed AS (
    SELECT * FROM {sql_cost_columns("f_planned")}
),
finance AS (
    SELECT {", ".join(_P.FINANCE_COLUMNS[:29])},
        {_PWM} AS pwm_sector_candidate,
        CAST(NULL AS DOUBLE) AS pwm_monthly_floor,
        CASE WHEN ({_PWM}) IS NOT NULL THEN 'policy_floor_not_configured' ELSE 'not_a_pwm_sector_candidate' END AS pwm_salary_check_status,
        'monthly_as_declared' AS salary_frequency_interpretation,
        false AS salary_frequency_review_required,
        skills
    FROM f_costed
)"""


def on_finance(body: str) -> str:
    return with_ctes(BIND, CLEAN, JOBS, FIN, body=body)


def repriced(s=_P.DEFAULT, where: str = "") -> str:
    """Finance fact with the cost columns recomputed for scenario ``s`` (P-07)."""
    cost = ["employer_burden_rate", "agency_premium_rate", "total_cost_multiplier",
            "loaded_monthly_cost_per_head", "loaded_monthly_cost_for_vacancies",
            "daily_loaded_cost_for_vacancies", "vacancy_budget_exposure", "vacancy_exposure_per_opening"]
    inner = f"(SELECT * EXCLUDE ({', '.join(cost)}) FROM finance {where})"
    return sql_cost_columns(inner, s)
