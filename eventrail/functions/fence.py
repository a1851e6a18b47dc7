"""Keep expensive columns from being evaluated again by filters above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, *names: str) -> DataFrame:
    """Fix the values of the named columns at this point of the plan.

    Catalyst pushes a filter through projections by substituting the filtered column's
    definition, level by level, which repeats parsing and multiplies long expressions.
    A generator over one struct ends that substitution: its outputs are plain columns.
    """
    packed = F.array(F.struct(*[F.col(name) for name in names]))
    kept = [F.col(name) for name in df.columns if name not in names]
    return df.select(*kept, F.inline(packed).alias(*names))
