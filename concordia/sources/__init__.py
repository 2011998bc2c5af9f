"""Readers, writers and generators of choice data."""
