"""Corpus preparation operators."""
