"""Structured Streaming forms of the call analysis and the daily aggregate."""
