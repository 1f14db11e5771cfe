"""Relational, temporal and statistical operators."""
