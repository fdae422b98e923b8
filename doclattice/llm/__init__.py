"""Training-data operators: mixing, dedup, filtering, redaction and token output.

Nothing outside this subpackage imports it.
"""
