"""Column and string functions."""
