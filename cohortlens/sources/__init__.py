"""Reading sheets and sampler output, and keeping result tables."""
