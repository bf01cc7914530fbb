"""Readers of raw requests and messages, and the event store."""
