"""Run logs, in batch and as a stream."""
