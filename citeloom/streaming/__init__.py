"""Streaming forms of time-based operators. The rest of the library is batch; these go beyond it."""
