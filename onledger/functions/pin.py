"""Compute a costly column once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read but never recompute.

    The optimizer copies the expression behind a plain column into every place that uses it. The output of a generator is
    a real column, so a one-element explode stops the copying. The value itself is computed in a projection below it, whose code
    Spark cuts into small compiled methods; inside the generator it would be one huge method, or interpreted.
    """
    kept = [c for c in rows.columns if c != name]
    return rows.select(*kept, value.alias("_pinned")).select(*kept, F.explode(F.array("_pinned")).alias(name))
