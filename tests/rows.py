"""Rows of a DataFrame as sorted tuples."""


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
