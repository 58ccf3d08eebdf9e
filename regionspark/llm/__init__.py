"""Operators for building a training corpus: dedup, filters, counts, mixing, output."""
