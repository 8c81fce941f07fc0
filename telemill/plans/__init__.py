"""Composed plans: rollups, read views and boards."""
