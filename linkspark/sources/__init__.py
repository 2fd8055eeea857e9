"""Readers and writers of the record sources."""
