"""Feeds, pages and model providers."""
