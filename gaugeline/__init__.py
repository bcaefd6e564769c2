"""Scoring of multi-rate sensor recordings against known-good runs, on Spark."""
