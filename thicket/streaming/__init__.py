"""Structured Streaming uses of the models."""
