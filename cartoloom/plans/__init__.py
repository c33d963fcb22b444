"""Whole tools as plans: from a source to lines or files."""
