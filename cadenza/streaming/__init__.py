"""Structured Streaming jobs: sessions, slot counts, deduplication, per-lane state, and the periodic tick."""
