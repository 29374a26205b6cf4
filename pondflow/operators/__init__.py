"""Keyed DataFrame -> DataFrame operators (series, windows, scans, lookups, stats, models)."""
