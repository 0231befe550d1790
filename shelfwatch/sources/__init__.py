"""Readers and parsers of everything that enters the tables."""
