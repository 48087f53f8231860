"""ratewise.operators."""
