"""Paperloom: a Spark-first engine for long, semi-structured documents."""
