"""Column expressions: hashing, errors, tests, ordinal bins, arrays and labels."""
