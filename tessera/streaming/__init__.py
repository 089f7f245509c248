"""Resumable processing by Structured Streaming."""
