"""Derived corpora, the registered queries and their SQL."""
