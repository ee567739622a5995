"""Whole queries, with their SQL."""
