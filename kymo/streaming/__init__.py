"""Structured Streaming forms of the event operators: an extension, as the reference has no streams."""
