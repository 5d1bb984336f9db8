"""Corpus preparation for language-model training: ten operators and a pipeline.

Nothing outside this subpackage imports it.
"""
