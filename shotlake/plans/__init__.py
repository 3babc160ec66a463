"""Registered queries, grouped by topic, each with its SQL."""
