"""Operators for preparing large text collections: filtering, deduplication, encoding, scoring, packing."""
