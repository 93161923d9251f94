"""Training-data operators: quality, mixing, dedup, packing, licences, PII, chat, search, LM scoring.

Nothing outside this subpackage imports it.  Operators take and return DataFrames; each documents
what it does with nulls, empty texts, ties, repeated rows and empty tables.
"""
