"""Structured Streaming jobs. Batch twins live in ``operators``."""
