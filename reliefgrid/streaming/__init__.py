"""Streaming sources, micro-batch state and sinks."""
