"""Readers of points."""
