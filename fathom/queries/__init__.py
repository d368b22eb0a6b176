"""Queries by theme; each module registers its own with the catalog."""
