"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one operator with a
general interface and the thin ``opN_<name>`` query that applies it to its whole table.
"""
