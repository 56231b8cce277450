"""Structured Streaming forms of the job, memory and rename operators."""
