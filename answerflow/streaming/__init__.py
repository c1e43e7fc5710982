"""Structured Streaming jobs over prompts, feedback and cascade events."""
