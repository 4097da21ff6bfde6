"""Operators for preparing training data from calls and documents."""
