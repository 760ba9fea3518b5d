"""Operators for building training data: dedup, mixing, packing, extraction, scoring and redaction.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if it is there.
"""
