"""Functions from DataFrame to DataFrame: labels, windows, sampling, metrics, comparison."""
