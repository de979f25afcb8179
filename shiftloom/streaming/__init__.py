"""Structured Streaming over the events table: additions of our own."""
