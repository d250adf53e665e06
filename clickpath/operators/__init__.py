"""Spark jobs: sessionization, session tables, scorecards, ranks, statistics, model."""
