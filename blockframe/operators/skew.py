"""Finding the few groups that are too big for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_KEY = ["source", "table_id"]

# Groups above this many rows are candidates for the split plan.
HOT_ROWS = 50_000


def hot_groups(df: DataFrame, keys=TABLE_KEY, floor: int = HOT_ROWS) -> DataFrame:
    """Keys of all groups with more than ``floor`` rows; counts are combined before the shuffle."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > floor)
        .select(*keys)
    )


def split_hot(df: DataFrame, hot: DataFrame, keys=TABLE_KEY) -> tuple[DataFrame, DataFrame]:
    """``(ordinary rows, rows of hot groups)``.

    The keys are joined without a hint: adaptive execution sends them to all
    tasks where it has measured that they are few, and shuffles otherwise.
    Both parts read ``df``, so it should be a stored table.
    """
    own = own_shuffle(hot, keys)
    return df.join(own, keys, "left_anti"), df.join(own, keys, "left_semi")


def own_shuffle(df: DataFrame, keys) -> DataFrame:
    """Give a lookup side of a join its own shuffle.

    Adaptive execution splits a skewed join partition only when both sides come
    straight from a shuffle; an aggregated side would otherwise bring its
    partitioning along and pin a hot key to one task.
    """
    return df.repartition(*keys)
