"""Relational, text, risk, panel, statistics and retrieval operators."""
