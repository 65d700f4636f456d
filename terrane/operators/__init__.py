"""Filters and statistics over tables of records."""
