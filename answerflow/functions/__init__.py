"""Column-level building blocks, used unchanged by batch and streaming jobs."""
