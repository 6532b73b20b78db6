"""Queries over the evidence model."""
