"""Training-data operators: packing, search, privacy, mixing, scoring and filters.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only while it is present.
"""
