"""Scoring and ingesting streams against what a batch run has learned."""
