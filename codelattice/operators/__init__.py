"""DataFrame-in, DataFrame-out operators on the code graph."""
