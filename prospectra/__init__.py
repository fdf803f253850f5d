"""Cohort benchmarking and ranked evaluation as Spark DataFrame plans."""
