"""Readers and writers, and the tables derived from the shared test data."""
