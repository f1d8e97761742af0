"""Parameters used by the registered queries on the driver's test tables.

The operators keep the reference defaults; the test binding spans 1995-2001
with a few thousand postings per sector, so thresholds that would leave no
qualifying group are scaled as listed in FIXTURES.md B.2.
"""
CUTOFF = "1999-01-01"            # engagement counter cutoff (default 2023-07-01)
RAMP_START = "1996-01-01"        # onboarding ramp end (default 2023-03-01)
WINDOW_MONTHS = 3                # M-08/M-09/M-10 window size
MIN_SEGMENT = 5                  # M-09 segment floor at sf0.01 (default 50)
ENTRY_WINDOW_MONTHS = 12         # entry() on sf0.001
MIN_LEVERAGE = 500               # M-12 (default 2000)
MIN_COHORT = 30                  # P-06, M-13, H-05, H-08..H-11, M-14
SCOPE_YEAR = 1997                # finance scope (F-05)
SCOPE_SECTOR = "Engineering"
SCOPE_MIN_COHORT = 5             # P-09 on one year and sector
MIN_LABEL_TOTAL = 200            # K-03
