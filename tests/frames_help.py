"""Helpers that several test files share."""


def rows(df, *cols):
    """The rows of ``df`` as sorted tuples of ``cols``."""
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
