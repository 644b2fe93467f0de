"""Readers that turn files into tables."""
