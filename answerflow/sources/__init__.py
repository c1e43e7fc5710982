"""Readers and writers for run logs and their summaries."""
