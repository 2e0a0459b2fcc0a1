"""Streams into stored tables."""

from .sink import append_stream

__all__ = ["append_stream"]
