"""Operators for preparing training text.

Nothing outside this subpackage imports it.  :mod:`quaybook.llm.entries` lists the registered queries.
"""
