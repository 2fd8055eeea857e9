"""Preprocessing of record streams."""
