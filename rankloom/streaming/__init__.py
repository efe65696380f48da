"""Structured Streaming over access logs and events."""
