"""Relational and text operators of the core library."""
