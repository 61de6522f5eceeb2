"""Sluice."""
