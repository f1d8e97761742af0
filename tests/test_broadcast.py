"""Join-free form of multi-scenario pricing."""
import io
from contextlib import redirect_stdout

from vacanta.operators import finance as P_


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_reprice_many_expands_rows_without_a_join(spark):
    rows = [("j1", "S", "Permanent", 1000.0, 2, 30), ("j2", "S", "Contract", 2000.0, 1, 15),
            ("j3", "T", "Other", 500.0, 3, 10)]
    fin = spark.createDataFrame(rows, "job_id string, sector string, employment_cohort string, "
                                      "planning_salary_midpoint_monthly double, number_of_vacancies int, "
                                      "posting_window_days int")
    a = P_.Scenario(permanent_employer_burden_rate=0.2, contract_employer_burden_rate=0.1,
                    contract_agency_premium_rate=0.05, days_per_month=30.0)
    b = P_.Scenario(permanent_employer_burden_rate=0.0, contract_employer_burden_rate=0.0,
                    contract_agency_premium_rate=0.0, days_per_month=30.0)
    out = P_.reprice_many(fin, [("a", a), ("b", b)])
    plan = _plan(out)
    assert "Join" not in plan and "CartesianProduct" not in plan and "Generate" in plan
    got = {(r["scenario"], r["job_id"]): (r["loaded_monthly_cost_per_head"], r["vacancy_budget_exposure"])
           for r in out.collect()}
    assert len(got) == 6
    for name, sc in (("a", a), ("b", b)):
        for job, _s, coh, mid, vac, days in rows:
            burden = {"Permanent": sc.permanent_employer_burden_rate,
                      "Contract": sc.contract_employer_burden_rate}.get(coh, 0.0)
            prem = sc.contract_agency_premium_rate if coh == "Contract" else 0.0
            head = mid * (1 + burden + prem)
            exp = head * vac / sc.days_per_month * days
            h, e = got[(name, job)]
            assert abs(h - head) < 1e-9 and abs(e - exp) < 1e-6
