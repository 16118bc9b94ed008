"""Registered queries over the driver's tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from . import corpus, estate, events, governance, graphs, orders, policies, programs, reports, search, sensitive, sourcecode, traces, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

ENTRY = "pii_tier_summary"
