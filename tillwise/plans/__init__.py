"""Registered queries: operators bound to the test tables, each with its oracle SQL."""
