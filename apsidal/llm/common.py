"""Helpers that the training-data operators share: lineage cuts, word patterns, skew-safe grouping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as every contract of this subpackage reads it.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Runs of it that are not already one space.
SPACE_CHANGES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: Largest table, in rows of a few numbers, that an operator broadcasts after counting it.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set as Spark's checkpoint folder.

    ``spark.checkpoint.dir`` is applied by Spark itself when the context starts. Where the session names
    none, a temporary folder is made in local mode only; on a cluster that is an error. What is written
    here is removed by Spark's cleaner if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a wide table once, as Parquet in the shared folder, and read it from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted table is small; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def squeezed(text: Column) -> Column:
    """Every run of white space becomes one space; null counts as empty. Single spaces are not matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CHANGES, " ")


def spaced(text: Column) -> Column:
    """Every white-space character becomes a space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """Array of the words of a text, in order (empty array for null or blank text)."""
    return F.array_remove(F.split(spaced(text), " "), "")


def hot_keys(df: DataFrame, keys: list[str], max_hot: int, min_hot: int) -> list[int]:
    """Hashes of the most frequent keys: at most ``max_hot`` numbers reach the driver.

    Whatever is not in the list has at most ``max(min_hot, rows / max_hot)`` rows, so no group that
    is left to one task grows beyond that share.
    """
    counts = df.select(F.xxhash64(*keys).alias("h")).groupBy("h").count().where(F.col("count") >= min_hot)
    return [r.h for r in counts.orderBy(F.desc("count"), "h").limit(max_hot).collect()]


def _hot(keys: list[str], hot: list[int]) -> Column:
    h = F.xxhash64(*keys)
    return h.isin(hot) if len(hot) <= 8 else F.array_contains(F.array(*map(F.lit, hot)), h)


def with_group_aggs(df: DataFrame, keys: Iterable[str], aggs: Mapping[str, Column], max_hot: int = 1000, min_hot: int = 1000) -> DataFrame:
    """Add per-key aggregates to every row without ever gathering a hot key in one task.

    Rows of ordinary keys get them from a window (one shuffle on the key). Rows of the few hot keys
    get them from an aggregate with map-side combine, which has at most ``max_hot`` groups (plus hash
    collisions) and is broadcast. Both give the same values; keys compare null-safe.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, max_hot, min_hot)
    w = Window.partitionBy(*keys)
    if not hot:
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    cold = df.where(~_hot(keys, hot)).select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    top = df.where(_hot(keys, hot))
    small = top.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[a.alias(n) for n, a in aggs.items()])
    same = [top[k].eqNullSafe(small[f"__{k}"]) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return cold.unionByName(top.join(F.broadcast(small), cond).select(*[top[c] for c in top.columns], *[small[n] for n in aggs]))


def looked_up(df: DataFrame, table: DataFrame, key: str, max_hot: int = 1000, min_hot: int = 1000) -> DataFrame:
    """Inner join with a table that has ``key`` once: hot keys of ``df`` meet their few rows by broadcast."""
    hot = hot_keys(df, [key], max_hot, min_hot)
    if not hot:
        return df.join(table, key)
    split = _hot([key], hot)
    return df.where(~split).join(table.where(~split), key).unionByName(df.where(split).join(F.broadcast(table.where(split)), key))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name, null-safe, keeping the left side's key columns only."""
    for k in keys:
        right = right.withColumnRenamed(k, f"__right_{k}")
    cond = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        cond = same if i == 0 else cond & same
    return left.join(right, cond, how).drop(*[f"__right_{k}" for k in keys])
