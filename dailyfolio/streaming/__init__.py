"""Structured Streaming jobs for ratings and settings."""
