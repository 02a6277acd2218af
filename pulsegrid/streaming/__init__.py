"""Structured Streaming jobs: sources, stateless and stateful operators, sinks."""
