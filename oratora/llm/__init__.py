"""Training-data operators: near-duplicates, decontamination, PII, packing and the like.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
query layer that ``__spark_entry__`` registers.
"""
