"""Structured Streaming form of the record sinks."""
