"""Structured Streaming: the batch columns over sources that grow."""
