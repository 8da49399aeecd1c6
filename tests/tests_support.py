"""Helpers shared by the test modules."""

import numpy as np


def to_grid(df, value, shape, fill=float("nan")):
    """A (row, col, value) table as an array."""
    out = np.full(shape, fill)
    for r in df.select("row", "col", value).collect():
        if r[value] is not None:
            out[r["row"], r["col"]] = r[value]
    return out
