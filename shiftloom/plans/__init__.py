"""Queries put together from operators, their SQL twins, and the batch interface."""
