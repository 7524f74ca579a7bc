"""Training-data operators: packing, search, dedup, scoring, mixing, archives.

Nothing else in the library imports this subpackage.  Each module holds one
operator behind a general interface; ``queries`` registers one query per
operator over the driver's tables.
"""
