"""Structured Streaming forms of the stateful operators; each equals its batch form once its input ends."""
