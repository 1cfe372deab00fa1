"""Row numbers over tables too large for one task: inside ranges first, then where each range starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str = "n") -> DataFrame:
    """df with `out`: 1, 2, … inside each group of `by` (of the whole table if empty), in `order`; ties as they come.

    Rows are dealt to ranges of (by, order), so a group of any size lies over many tasks; what is numbered in one window is a
    range's part of a group, and then the groups' ranges. Null keys are a group."""
    ranged = df.repartitionByRange(*(F.col(f"`{c}`") for c in by), *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    keys = [F.col(f"`{c}`") for c in by]
    parts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(*(k.alias(f"_by{i}") for i, k in enumerate(keys)), F.col("_range").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = ranged.withColumn("_inside", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_by{i}"))
    return inside.join(starts, same).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_start") + F.col("_inside")).alias(out))
