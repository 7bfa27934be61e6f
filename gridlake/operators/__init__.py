"""Operators over pixel, block, polygon and prediction tables."""
