"""Execution patterns that several operators share: quantiles, ranks, frequencies, scratch storage."""
