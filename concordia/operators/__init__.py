"""Relational operators over choice data."""
