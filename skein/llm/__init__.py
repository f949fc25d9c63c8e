"""Training-data operators: cleaning, dedup, mixing, tokenising, sharding, archives.

Nothing outside this subpackage imports it.  ``queries.py`` registers one
query per operator; every module documents what it does with nulls, empty and
very long texts, ties, repeated rows, empty tables and extra columns.
"""
