"""Readers and writers for raw events, rollup tables and feeds."""
