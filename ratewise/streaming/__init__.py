"""ratewise.streaming."""
