"""Operators for corpora and item sets; nothing outside this package imports it."""
