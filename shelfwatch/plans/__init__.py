"""Composite jobs and serving queries."""
