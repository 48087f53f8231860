"""ratewise.sources."""
