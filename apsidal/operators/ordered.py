"""Neighbours and places within a key's order, with no task that holds a whole key.

All rows are numbered by one distributed sort over the keys and the order, and dealt in blocks of numbers, so a
key with most of the rows is spread over as many tasks as any other rows. A null key is a key of its own. The
order should be total; ties fall as the sort leaves them. Column names that begin with ``__`` and ``rn`` are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .encounters import numbered

#: Rows of a block: what one window may hold.
BLOCK = 50_000


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], columns: Callable[[WindowSpec], dict[str, Column]], reach: int, block: int = BLOCK) -> DataFrame:
    """df and ``columns`` taken over a window of each key that reaches at most ``reach`` rows back.

    The last ``reach`` rows of a block are copied to the next ones, and only a block's own rows are kept.
    """
    rows = numbered(df, *keys, *order).withColumn("__own", F.floor(F.col("rn") / block))
    copies = rows.withColumn("__block", F.explode(F.sequence("__own", F.floor((F.col("rn") + reach) / block))))
    w = Window.partitionBy("__block", *keys).orderBy("rn")
    return copies.withColumns(columns(w)).where("__block = __own").drop("__block", "__own", "rn")


def placed(df: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """df with ``place``, from 0, and ``of``, the rows of the key: a key's first number and size come from one row a block and key."""
    rows = numbered(df, *keys, *order).withColumn("__block", F.floor(F.col("rn") / block))
    whole = Window.partitionBy(*[f"__key_{k}" for k in keys])
    parts = rows.groupBy(F.col("__block").alias("__part"), *[F.col(k).alias(f"__key_{k}") for k in keys]).agg(F.min("rn").alias("__first"), F.count(F.lit(1)).alias("__n"))
    parts = parts.withColumns({"__first": F.min("__first").over(whole), "of": F.sum("__n").over(whole)}).drop("__n")
    met = F.col("__block") == F.col("__part")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return rows.join(parts, met).withColumn("place", F.col("rn") - F.col("__first")).drop("rn", "__block", "__part", "__first", *[f"__key_{k}" for k in keys])


def arc_spans(df: DataFrame, key: str, angle: str, block: int = BLOCK) -> DataFrame:
    """key, span_deg, last_deg of the arc that covers all angles of a key: 360 degrees less the largest gap.

    last_deg is the angle before that gap, the smallest of equal ones; one angle spans nothing; nulls do not count.
    """
    angles = df.select(key, F.col(angle).cast("double").alias("__a")).where("__a is not null").distinct()
    inner = with_neighbours(angles, [key], ["__a"], lambda w: {"__from": F.lag("__a").over(w)}, 1, block).where("__from is not null")
    gaps = inner.select(key, F.col("__from").alias("__at"), (F.col("__a") - F.col("__from")).alias("__gap"))
    closing = angles.groupBy(key).agg(F.max("__a").alias("__at"), (F.min("__a") + 360 - F.max("__a")).alias("__gap"))
    return gaps.unionByName(closing).groupBy(key).agg((360 - F.max("__gap")).alias("span_deg"), F.max_by("__at", F.struct("__gap", -F.col("__at"))).alias("last_deg"))
