"""Training-data operators: search, near-duplicates, tokens, extraction, filters, packing, fixity.

Nothing else in the library imports this package; its queries join the
catalogue in ``__spark_entry__.py`` only where the package is present.
"""
