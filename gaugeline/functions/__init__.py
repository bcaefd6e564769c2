"""Scalar expressions: Columns in, Columns out, all inside generated code."""
