"""Corpus operators: archives, tokenizing, formatting, deduplication, scoring and scanning of text tables."""
