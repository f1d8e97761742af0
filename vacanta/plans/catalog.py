"""Imports every query module so the registry is complete."""
from __future__ import annotations

from . import q_clean, q_finance, q_hirer, q_io, q_market, q_quality, q_seeker, q_stats  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
