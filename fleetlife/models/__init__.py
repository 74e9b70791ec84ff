"""Models fitted per cell: closed forms on unit sums, and Spark ML estimators."""
