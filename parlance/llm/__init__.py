"""Training-data operators: extraction, quality, fingerprints, deduplication, mixing, tokenisation.

Nothing else in the library imports this subpackage; the queries it offers are in
``parlance.llm.registry``.
"""
