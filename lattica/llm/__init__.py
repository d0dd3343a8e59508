"""Operators for preparing training text: scanning, formatting, dedup, filtering, mixing, counting."""
