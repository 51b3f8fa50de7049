"""Structured Streaming jobs: replay, scoring, dashboard summaries."""
