"""Training-data operators: duplicates, contamination, secrets, packing, PII, toxicity, fingerprints, LM, quality.

Nothing outside this subpackage imports it. ``registry`` holds its queries and their SQL.
"""
