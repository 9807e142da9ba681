"""Training-data operators (token packing, near-duplicate search, scans, mixing).

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when the package is present.
"""
