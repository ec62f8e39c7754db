"""Operators for preparing training data (quality, safety, deduplication, mixing, packing, token files, vector search).

Nothing outside this subpackage imports it; ``queries`` holds its registered queries and their SQL.
"""
