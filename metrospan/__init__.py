"""Measurement-study analytics expressed as Spark DataFrame jobs."""
