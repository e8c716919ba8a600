"""Shapes of plans that operators share."""
