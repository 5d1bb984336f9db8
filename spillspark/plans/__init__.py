"""Composed analytics and the registered queries with their SQL."""
