"""Structured Streaming: sinks and jobs. All queries take what is available and stop, from a checkpoint."""
