"""Whole plans: chains of operators, and the catalogue of queries."""
