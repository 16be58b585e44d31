"""Contextual anomaly analytics on Spark: baselines, detectors, cases, and their queries."""
