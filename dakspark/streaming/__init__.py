"""Structured Streaming jobs for feedback, quotas and usage."""
