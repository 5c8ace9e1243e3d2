"""Operators for preparing training data at corpus scale. Nothing outside imports this package."""
