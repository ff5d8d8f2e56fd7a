"""The last value seen, carried down an ordered log or file without one task for a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, values: dict[str, Column], by: list[str], bucket: Column, order: list[str], inclusive: bool = True) -> DataFrame:
    """df with, for each name, the last non-null value at or before each row of its group (before it, if not inclusive).

    bucket deals the order of a group into stretches: it must not fall as the
    order rises. Each stretch is a window of its own; what a stretch hands on to
    the next ones is one row, and only those rows meet in a window of the group.
    """
    rows = df.withColumns({"__bucket": bucket, **{f"__v_{n}": c for n, c in values.items()}})
    place = F.struct(*order)
    ends = rows.groupBy(*by, "__bucket").agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__e_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"__k_{c}") for c in [*by, "__bucket"]], *[F.last(f"__e_{n}", True).over(before).alias(f"__b_{n}") for n in values])
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*by, "__bucket"]])
    own = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumns({f"__l_{n}": F.last(f"__v_{n}", True).over(own) for n in values}).join(ends, met, "left")
    return out.select(*[c for c in df.columns if c not in values], *[F.coalesce(f"__l_{n}", f"__b_{n}").alias(n) for n in values])
