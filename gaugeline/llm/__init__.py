"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
applies them to the ``documents`` table.  Nothing outside this folder (other
than the entry module, behind an import guard) depends on it.
"""
