"""ratewise.sinks."""
