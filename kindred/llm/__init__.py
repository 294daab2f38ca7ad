"""Operators for preparing training text.  Nothing else in kindred imports this."""
