"""Readers of vector geodata files into one table of records."""
