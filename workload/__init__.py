"""Registered queries: each operator wired to the given tables, with its SQL twin."""
