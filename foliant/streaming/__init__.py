"""Streaming jobs over logs."""
