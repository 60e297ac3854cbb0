"""Alignment, table scoring and duplicate detection."""
