"""Operators for building training data from filings: matching, near copies, text forms, tokens, packing, reading level."""
