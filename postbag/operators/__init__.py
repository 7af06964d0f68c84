"""Operators over message tables."""
