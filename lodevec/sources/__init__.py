"""Corpora, configuration, fixtures and report sinks."""
