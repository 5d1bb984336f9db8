"""Structured Streaming extensions over position reports."""
