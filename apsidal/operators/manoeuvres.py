"""Candidate burns of an alert: their list, the shortlist, the final choice; fragments against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.burns import BURN_MS, DIRECTIONS
from ..sources.derived import grid_by_step, states_at
from .graph import checkpoint
from .screening import _settled, band_width, dealt_by_part, in_bands

#: Objects times steps that a task of a join in space lays out, and a number above all steps.
STATES_A_BLOCK, STEP_RANGE = 120_000, 1 << 20
ALL_CELLS = [(i, j, m) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)]


def dealt(jobs: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Deal narrow rows by their key before they multiply, so that no multiplied row moves afterwards.

    The number of partitions is given, or the few bytes would be coalesced before they grow. ``most``: rows of
    a partition, about; they are counted, so that a task does not grow with the table.
    """
    spark = jobs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return jobs.repartition(max(parts, -(-jobs.count() // most)) if most else parts, key)


def burn_candidates(jobs: DataFrame) -> DataFrame:
    """Each mover row with six directions of eight sizes: dir (index), mag (index), dv."""
    grid = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(m).alias("mag"), F.lit(s).alias("dv")) for d in range(len(DIRECTIONS)) for m, s in enumerate(BURN_MS)])
    return jobs.withColumn("c", F.explode(grid)).select("*", "c.*").drop("c")


def shortlist(options: DataFrame, target: float, most: int = 4) -> DataFrame:
    """The options of each alert worth a check against the catalogue, with place.

    Reads alert_id, mover, owner_known, dir, mag, dv, miss, pc9. First the smallest burn of every mover and
    direction that reaches the target, then other burns that reach it, then the lowest probabilities; of
    these ``most``, in order of reaching, known owner, size, larger miss. An alert has at most 96 rows, and
    rows dealt by alert are not moved again.
    """
    reach = F.col("pc9") < target
    key = [F.desc("owner_known"), F.asc("dv"), F.desc("miss"), F.asc("mover"), F.asc("dir")]
    of = Window.partitionBy("alert_id")
    first = reach & (F.row_number().over(Window.partitionBy("alert_id", "mover", "dir").orderBy(F.desc(reach), *key)) == 1)
    pool = F.when(first, 0).when(reach, 1).otherwise(2)
    out = options.withColumn("pool", pool).withColumn("reach", reach)
    take = F.row_number().over(of.orderBy("pool", F.when(F.col("pool") == 2, F.col("pc9")).otherwise(0.0), F.when(F.col("pool") == 2, F.col("dv")).otherwise(0.0), *key))
    out = out.withColumn("take", take).where(F.col("take") <= most)
    return out.withColumn("place", F.row_number().over(of.orderBy(F.desc("reach"), *key))).drop("take", "pool")


def final_choice(picked: DataFrame) -> DataFrame:
    """alert_id, branch, place of the option to fly, place of the one that the pair alone would name.

    Reads place, reach, pc9, cascade_safe (null: not checked), secondary_pc. Branches: safe and reaching;
    safe with the lowest probability; checked but none safe, the least secondary risk; not checked.
    """
    safe, reach, place = F.coalesce(F.col("cascade_safe"), F.lit(False)), F.col("reach"), F.col("place")
    a = F.min(F.when(safe & reach, place))
    b = F.min_by("place", F.when(safe, F.struct("pc9", "place")))
    c = F.min_by("place", F.struct(F.coalesce("secondary_pc", F.lit(1.0)), "pc9", "place"))
    naive = F.coalesce(F.min(F.when(reach, place)), F.min_by("place", F.struct("pc9", "place")))
    out = picked.groupBy("alert_id").agg(a.alias("a"), F.max(safe).alias("some"), b.alias("b"), c.alias("c"), naive.alias("naive"), F.count("cascade_safe").alias("checked"), F.count(F.lit(1)).alias("options"))
    branch = F.when(F.col("a").isNotNull(), "safe_target").when(F.col("some"), "safe_reduction").when(F.col("checked") > 0, "none_safe").otherwise("pair_only")
    chosen = F.coalesce("a", F.when(F.col("some"), F.col("b")), F.when(F.col("checked") > 0, F.col("c")), "naive")
    return out.select("alert_id", "options", branch.alias("branch"), chosen.alias("chosen"), "naive")


def fragment_hits(fragments: DataFrame, objs: DataFrame, steps: int, step_s: float, threshold_km: float, active: Column, own: Column, speed_kms: float = 16.0) -> DataFrame:
    """fragment, sat, k, miss_km, t_s, hits: the nearest straight-line approach of every fragment and object below the threshold.

    ``active`` says of a fragment's row (id, k) whether it is released and not decayed, ``own`` of a pair
    (fragment, sat) whether the object is a parent. Both sides are dealt by step; fragments stream past
    the 27 cells around theirs, objects stand in their own, in the bands of radius that they can meet, so a task's hash table is small; the join moves nothing. The best of a pair is
    an aggregate that combines before its shuffle; equal misses (to the millimetre) go to the earlier step.
    The best steps are computed here and checkpointed.
    """
    with dealt_by_part(objs.sparkSession):
        return _fragment_hits(fragments, objs, steps, step_s, F.lit(threshold_km), threshold_km, active, own, speed_kms)


def corridor_hits(movers: DataFrame, objs: DataFrame, steps: int, step_s: float, gate: Column, widest_km: float, own: Column, speed_kms: float = 16.0) -> DataFrame:
    """The same of many movers (burned or not), each with a gate of its own against one shared catalogue grid.

    ``gate`` (km) is a column of the pair (fragment, sat, k), at most ``widest_km``, which sets the cells.
    The catalogue is laid out once, however many movers there are.
    """
    with dealt_by_part(objs.sparkSession):
        return _fragment_hits(movers, objs, steps, step_s, F.least(gate, F.lit(widest_km)), widest_km, F.lit(True), own, speed_kms)


def _fragment_hits(fragments: DataFrame, objs: DataFrame, steps: int, step_s: float, gate: Column, widest_km: float, active: Column, own: Column, speed_kms: float) -> DataFrame:
    half = step_s / 2
    radius = widest_km + speed_kms * half
    spark = objs.sparkSession
    state = ["x", "y", "z", "vx", "vy", "vz"]
    at = [F.floor(F.col(c) / radius) + 1024 for c in "xyz"]
    cell = ((at[0] * 2048 + at[1]) * 2048 + at[2]).alias("cell")
    width = band_width(widest_km, half)
    block = max(2, min(8, STATES_A_BLOCK // max(1, objs.count())))
    laid = lambda df: _settled(grid_by_step(df, steps, step_s, keep=["a_km"], block=block))
    f = in_bands(laid(fragments).where(active), width).select("block", "k", cell, "band", F.col("id").alias("fragment"), *state)
    ways = spark.createDataFrame([((x * 2048 + y) * 2048 + z,) for x, y, z in ALL_CELLS], "way long")
    f = f.crossJoin(F.broadcast(ways)).withColumn("cell", F.col("cell") + F.col("way")).drop("way")  # 27 rows
    s = in_bands(laid(objs), width, both=True).select("block", "k", cell, "band", F.col("id").alias("sat"), *[F.col(c).alias(f"{c}2") for c in state])
    both = f.join(s.hint("shuffle_hash"), ["block", "k", "cell", "band"]).where(~own)
    miss, _ = _straight(half)
    hits = _settled(_relative(both, "fragment", "sat", "k").where(F.col("dd") <= radius * radius).withColumn("miss_km", miss)).where(F.col("miss_km") < gate)
    # the best step as one number, nearest to the millimetre, then the earlier: it is combined by hashes and moves as sixteen bytes
    order = F.floor(F.col("miss_km") * 1e6 + 0.5) * STEP_RANGE + F.col("k")
    best = hits.groupBy("fragment", "sat").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("hits"))
    best = checkpoint(best.select("fragment", "sat", (F.col("best") % STEP_RANGE).cast("int").alias("k"), "hits"))
    # what came nearest is placed again at that step
    one = states_at(best.withColumn("id", F.col("fragment")).join(_small(fragments), "id"), step_s, ["sat", "hits"])
    one = one.select(F.col("id").alias("fragment"), "k", "hits", F.col("sat").alias("id"), F.struct(*state).alias("one"))
    two = states_at(one.join(_small(objs), "id"), step_s, ["fragment", "hits", "one"])
    pair = two.select("fragment", F.col("id").alias("sat"), "k", "hits", *[F.col(c).alias(f"{c}2") for c in state], "one.*")
    near = _relative(pair, "fragment", "sat", "k", "hits")
    miss, t = _straight(half)
    return near.select("fragment", "sat", "k", miss.alias("miss_km"), (F.col("k") * step_s + t).alias("t_s"), "hits")


def _small(orbits: DataFrame, most: int = 2_000_000) -> DataFrame:
    orbits = orbits.select("id", "a_km", "inc", "raan", "phase")
    return F.broadcast(orbits) if orbits.count() <= most else orbits


def _relative(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep with the products dd, dv, vv of the relative state of two (x and x2, and so on)."""
    d, v = [F.col(c) - F.col(f"{c}2") for c in "xyz"], [F.col(f"v{c}") - F.col(f"v{c}2") for c in "xyz"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return _settled(rows.select(*keep, dot(d, d).alias("dd"), dot(d, v).alias("dv"), dot(v, v).alias("vv")))


def _straight(half: float) -> tuple[Column, Column]:
    """Nearest distance of two straight lines within half a step, and its time from the step."""
    t = F.greatest(F.lit(-half), F.least(F.lit(half), -F.col("dv") / F.greatest(F.col("vv"), F.lit(1e-12))))
    return F.sqrt(F.greatest(F.lit(0.0), F.col("dd") + 2 * t * F.col("dv") + t * t * F.col("vv"))), t
