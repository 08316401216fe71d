"""Prefix sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranged_prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, scratch) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come before or at the row in ``order``.

    Rows are sorted globally by range over keys and order, so a group of any size is cut into ranges of bounded size; the sums
    of the ranges (one row per range and group) are added up, then each range inside. Rows with the same keys and order must
    be told apart by ``order``. Null values count as 0. An empty table gives an empty table.
    """
    cols = df.columns
    v = F.coalesce(F.col(value), F.lit(0))
    # written once: a range's bounds are drawn anew whenever the plan is run
    cut = scratch.save(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    parts = cut.groupBy(*keys, "_range").agg(F.sum(v).alias("_part"))
    base = parts.withColumn("_base", F.sum("_part").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)))
    base = base.select(*keys, "_range", F.coalesce("_base", F.lit(0)).alias("_base"))
    inner = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return cut.join(F.broadcast(base) if not keys else base, [*keys, "_range"]).select(*cols, (F.col("_base") + F.sum(v).over(inner)).alias(out))
