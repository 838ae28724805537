"""Operators over large text and code collections for training data.

Nothing outside this package imports it.
"""
