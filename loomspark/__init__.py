"""Corpus retrieval and preference analytics as DataFrame transformations."""
