"""Geometry and array expressions."""
