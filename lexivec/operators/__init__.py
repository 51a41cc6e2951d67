"""Operators over chunk, posting and hit tables."""
