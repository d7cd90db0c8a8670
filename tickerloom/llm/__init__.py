"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds the registry that the
entry module adds when the subpackage is present.
"""
