"""Structured text evaluation on Spark: scans, normalisation, alignment, metrics, experiment logs."""
