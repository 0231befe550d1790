"""Structured Streaming jobs; every one restarts from its checkpoint without repeating output."""
