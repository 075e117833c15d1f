"""Whole queries: the clause block and the registered queries built on it."""
