"""Spark-first analytics over provenance-graph logs."""
