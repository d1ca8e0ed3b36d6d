"""Registered queries, their SQL counterparts and the page plans."""
