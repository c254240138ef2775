"""Retrieval, index and evaluation operators."""
