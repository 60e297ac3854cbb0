"""Evaluation and report plans."""
