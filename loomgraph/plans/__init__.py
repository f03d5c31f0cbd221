"""Queries composed from operators."""
