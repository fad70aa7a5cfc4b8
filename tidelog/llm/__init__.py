"""Training-data operators: language ID, near-duplicates, decontamination, PII, tokens and the rest.

Nothing else in the package imports this subpackage. Each module holds one
operator with a general interface; ``registry`` holds the thin queries.
"""
