"""Evaluation of parser outputs as they arrive."""
