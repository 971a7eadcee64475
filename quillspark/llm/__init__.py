"""Training-data operators: packing, language ID, URL filters, near-duplicates, kNN,
media sniffing, quality, mixing, substring dedup and revisit resolution.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query per operator.
"""
