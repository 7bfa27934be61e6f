"""Incremental processing of newly arrived images."""
