"""Readers and writers of evaluation corpora."""
