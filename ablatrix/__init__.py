"""QA-corpus and parameter-table processing expressed as Spark DataFrame jobs."""
