"""DataFrame operators: ordered scans, sections, spacing, intervals, bins,
cleaning, sampling, metrics, neighbours and outliers."""
