"""Structured Streaming forms of the windowed operators (an extension; batch operators need none of this)."""
