"""Training-data operators: packing, quality, language, secrets, mixing, dedup, search, fingerprints, extraction.

Nothing outside this package imports it; it imports nothing from the rest of the library.
"""
