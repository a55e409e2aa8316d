"""Operators for building large text corpora: extraction, filtering, deduplication, mixing."""
