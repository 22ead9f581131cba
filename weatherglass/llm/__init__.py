"""Training-data operators: scans, de-duplication, scoring, sharding and encoding of text corpora.

Nothing outside this subpackage imports it.
"""
