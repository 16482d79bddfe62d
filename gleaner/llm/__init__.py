"""Operators for large text corpora that become training data.

Nothing outside this subpackage imports it.  ``gleaner.llm.queries`` holds the
thin ``opN_<name>`` queries, one for each operator, and their SQL.
"""
