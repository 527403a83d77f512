"""Structured Streaming: a live loss report over the training log."""
