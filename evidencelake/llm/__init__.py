"""Training-data operators: quality rules, packing, near and exact dedup, language
and toxicity models, secret scans, mixing and token counts.

Nothing outside this subpackage imports it.
"""
