"""Joins by time: the last row before each (as-of), and rows within intervals. Neither compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, take: list[str], order: str, within: float | None = None) -> DataFrame:
    """left with `take` of the last row of right at or before it, by key; nulls where there is none, or none `within` of it.

    Both sides become one frame, one shuffle by key, and a window carries the
    last row of right forward: no inequality is joined. Of right rows at one
    time the one with the greatest `order` counts. Rows of left repeat as they
    do; a null key or time finds nothing. All rows of a key are sorted in one
    task (on disk where they don't fit).
    """
    kept = [c for c in left.columns if c not in take]
    found = F.struct(F.col(right_at).alias("at"), *take)
    typed = right.select(found.alias("x")).schema["x"].dataType
    a = left.select(F.col(by).alias("key"), F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[order].dataType).alias("nth"), F.struct(*kept).alias("row"), F.lit(None).cast(typed).alias("found"))
    b = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull()).select(F.col(by).alias("key"), F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(order).alias("nth"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), found.alias("found"))
    last = F.last("found", ignorenulls=True).over(Window.partitionBy("key").orderBy("at", "side", "nth").rowsBetween(Window.unboundedPreceding, 0))
    near = F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("last").isNotNull()
    if within is not None:
        near &= F.col("at") - F.col("last.at") <= within
    return a.unionByName(b).withColumn("last", last).where("side = 1").select("row.*", *[F.when(near, F.col(f"last.{c}")).alias(c) for c in take])


def interval_join(spans: DataFrame, points: DataFrame, start: str, end: str, at: str, width: float, by: str | None = None) -> DataFrame:
    """Rows of spans with each row of points at or after `start` and before `end`, of equal `by` where it is named.

    Time is cut into bins of `width`; a span stands once in every bin that it
    touches, a point in its own, bins are joined as keys, and the exact test
    follows. Choose a width near a usual span's: shorter ones copy spans more,
    longer ones bring more points to the test. Null and empty spans find
    nothing. A crowded bin is a hot join key, which adaptive execution splits.
    """
    bin_ = lambda c: F.floor(c / F.lit(width)).cast("long")
    keys = ["tallyfold_bin", *([by] if by else [])]
    last = F.when(F.col(end) / F.lit(width) == bin_(F.col(end)), bin_(F.col(end)) - 1).otherwise(bin_(F.col(end)))
    over = spans.where(F.col(start) < F.col(end)).withColumn("tallyfold_bin", F.explode(F.sequence(bin_(F.col(start)), F.greatest(last, bin_(F.col(start))))))
    held = points.where(F.col(at).isNotNull()).withColumn("tallyfold_bin", bin_(F.col(at)))
    return over.join(held, keys).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("tallyfold_bin")
