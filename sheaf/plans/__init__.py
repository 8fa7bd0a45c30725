"""Whole entry operations, composed from the operators."""
