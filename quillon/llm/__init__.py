"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` registers the thin
``opN_<name>`` queries and the SQL that checks them.
"""
