"""Readers of frames, documents and listings."""
