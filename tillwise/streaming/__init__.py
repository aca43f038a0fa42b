"""Structured Streaming forms of the feed, log and metric jobs."""
