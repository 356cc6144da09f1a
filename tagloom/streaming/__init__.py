"""Markup in Structured Streaming."""
