"""DataFrame-in, DataFrame-out operators of the three layers."""
