"""Operators for preparing training text at scale. Nothing else in linkspark imports this package."""
