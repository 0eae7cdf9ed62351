"""Structured Streaming and orchestration."""
