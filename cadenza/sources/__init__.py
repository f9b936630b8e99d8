"""Readers of the engine's inputs, with explicit schemas."""
