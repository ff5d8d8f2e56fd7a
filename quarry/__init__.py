"""Set-based analytics for issue triage, test coverage and large text corpora, on Spark."""
