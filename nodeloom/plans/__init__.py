"""Whole jobs: the report, its plots, and the registered queries with their SQL."""
