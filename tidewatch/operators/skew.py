"""Hot join keys dealt into parts, so that no task holds all pairs of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins.
HOT = 4096


def dealt(x: DataFrame, y: DataFrame, keys: list[str], by: str, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``x`` and ``y``, to be joined by ``keys``, with a further key ``part``: the rows of ``x`` under keys that have more than ``hot``
    of them are dealt into parts by the hash of ``by``, those of ``y`` under such keys are repeated for each part.

    Counts are summed before the shuffle; at most ``rows / hot`` keys are hot, so Spark broadcasts their list while it is small."""
    large = x.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(hot)).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    left = x.join(large, keys, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    right = y.join(large, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left, right
