"""Data work for language models as Spark DataFrame jobs."""
