"""Whole query plans made of the operators."""
