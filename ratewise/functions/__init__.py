"""ratewise.functions."""
