"""Operators for preparing training corpora: joins, filters, tokens and archives."""
