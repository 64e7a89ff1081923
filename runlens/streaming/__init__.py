"""Structured Streaming forms of the sync, the volume series and the timers."""
