"""Fused fits, and the registered queries with their SQL."""
