"""Join helpers with an explicit size check before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimension rows we allow to ship to every executor.
MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the dimension is proven small.

    The count runs on the dimension alone (a small table by construction), so
    the check is cheap; beyond the bound the frame is returned unhinted and
    AQE picks the join from runtime sizes (sort-merge for large inputs).
    """
    n = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if n <= max_rows else dim


def enrich_with_spec(trials: DataFrame, spec: DataFrame, key: str = "gpu_name",
                     max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Trial -> GPU specification left equi-join (J1); hardware columns stay
    NULL for GPUs the dimension does not know."""
    return trials.join(bounded_broadcast(spec, max_rows), key, "left")
