"""Checks of traces as they arrive."""

from stepforge.streaming.live import lint_stream

__all__ = ["lint_stream"]
