"""Landed inputs, registries and sinks."""
