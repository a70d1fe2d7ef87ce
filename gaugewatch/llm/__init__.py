"""Operators for training data: counting, searching, cleaning and mixing large text tables."""
