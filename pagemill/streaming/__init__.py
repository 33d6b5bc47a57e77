"""Streams of progress messages."""
