"""Imports every query module so that the catalogue is complete."""

from tillwise.plans import q_events, q_finance, q_forecast, q_logs, q_official, q_pages, q_policy, q_programs, q_stream, q_text  # noqa: F401
from tillwise.plans.catalog import ORACLES, QUERIES  # noqa: F401
