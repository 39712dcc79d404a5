"""Readers of prices, manifests, corpora, vocabularies and lines."""
