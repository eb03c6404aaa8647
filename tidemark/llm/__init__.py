"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it.
"""
