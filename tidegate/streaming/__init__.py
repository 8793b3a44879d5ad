"""Structured Streaming jobs for the event-sourced parts."""
