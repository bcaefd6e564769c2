"""Operators over recordings.  A recording is a ``run_id``; all are lazy."""
