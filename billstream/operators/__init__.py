"""DataFrame-in, DataFrame-out operators of the invoice pipeline."""
