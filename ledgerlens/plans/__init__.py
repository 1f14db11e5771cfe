"""Compositions: risk mart, portfolio reports, feature frame, split and model."""
