"""Readers that turn outside formats into frames, and the change-only sink."""
