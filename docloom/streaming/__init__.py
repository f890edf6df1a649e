"""Streaming of docloom."""
