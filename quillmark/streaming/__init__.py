"""Structured Streaming forms of the core operators."""
