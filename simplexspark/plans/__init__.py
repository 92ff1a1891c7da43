"""Registered queries: each a plan over the given tables, most with its SQL twin."""
