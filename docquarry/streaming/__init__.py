"""Incremental work: windowed streams and stateful monitoring."""
