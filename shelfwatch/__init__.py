"""Storefront catalog analytics expressed as Spark DataFrame and streaming jobs."""
