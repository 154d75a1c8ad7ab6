"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it.
"""
