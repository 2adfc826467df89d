"""Corpus index, ranked search, usage telemetry and redaction on Spark DataFrames."""

__version__ = "0.1.0"
