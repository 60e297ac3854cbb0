"""Which embeddings take part, and their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    # a null component: `forall` is null, which coalesces to false
    finite = F.coalesce(F.forall(v, lambda x: (~F.isnan(x)) & (F.abs(x) < float("inf"))), F.lit(False))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def matrix(cells):
    """Rows of lists, as a matrix of doubles."""
    import numpy as np

    return np.array([np.asarray(c, np.float64) for c in cells])
