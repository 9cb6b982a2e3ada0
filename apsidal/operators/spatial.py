"""Joins in space and of sets: points with radii of their own, contained sets, minima of pairs on sampled tracks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import states_at
from .graph import checkpoint
from .screening import _settled, copies, dealt_by_part
from .statistics import histogram_quantiles

#: Edge (km) of the smallest cells; each level doubles it.
CELL_KM = 64.0
#: Largest speed of an object (km/s), which bounds how far it is from its grid position.
SPEED_KMS = 8.0
#: Widening (km) of every ball, against rounding between the step and the exact time.
SLACK_KM = 1e-3
#: Queries that a task holds, each up to 27 times.
QUERIES_A_TASK = 50_000
#: Names of the cells of a level; cells may share one. The level is the rest of the number, 0 to 31.
CELL_NAMES = 1 << 26


def dealt_by_step(queries: DataFrame, key: str, step_s: float = 60.0) -> tuple[DataFrame, tuple[int, int]]:
    """queries (with t_s) and the column deal, by which they are dealt; and the numbers of shares of a step and of tasks.

    A deal is a share of the queries of one grid step: k * shares + share, the share by the hash of ``key``. A step has as many
    shares as fill the tasks, whose number follows that of the queries.
    """
    spark, k = queries.sparkSession, F.floor(F.col("t_s") / step_s + 0.5)
    n, steps = queries.agg(F.count(F.lit(1)), F.count_distinct(k)).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, -(-n // QUERIES_A_TASK))
    shares = max(1, -(-4 * tasks // max(1, steps)))
    return queries.withColumn("deal", (k * shares + F.pmod(F.hash(key), F.lit(shares))).cast("int")).repartition(tasks, "deal"), (shares, tasks)


def near_orbits(queries: DataFrame, orbits: DataFrame, layout: tuple[int, int], keys: list[str], step_s: float = 60.0, most: int = 500_000) -> DataFrame:
    """deal, keys, id, distance_km of all orbits within each query's own radius at the query's own time.

    ``queries`` has deal, t_s, x, y, z, radius_km and comes from ``dealt_by_step``; ``orbits`` are circular. Every deal places the
    orbits, of which up to ``most`` are broadcast, at its step, in cells of the levels that its radii ask for. A query looks
    into the at most 27 cells of its level that its ball, widened by the way from the step to its own time, meets; what lies
    in the widened ball at the step is placed at the exact time. So no pair is moved, and the pairs stay dealt as the queries
    are, if the job runs under ``dealt_by_part``.
    """
    shares, tasks = layout
    k = F.floor(F.col("deal") / shares)
    q = queries.withColumn("reach", F.col("radius_km") + SPEED_KMS * F.abs(F.col("t_s") - k * step_s) + SLACK_KM)
    q = q.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(31), F.ceil(F.log2(F.col("reach") / CELL_KM)))).cast("int"))
    q = q.withColumn("size", F.lit(CELL_KM) * F.pow(F.lit(2.0), F.col("level")))
    along = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / F.col("size")), F.floor((F.col(c) + F.col("reach")) / F.col("size"))))
    # deal and cell are one number to the join, by the cell's name; that it is the cell itself is asked of what meets
    named = lambda level, x, y, z: F.pmod(F.hash(x, y, z), F.lit(CELL_NAMES)) + level * CELL_NAMES
    probes = q.withColumn("cx", along("x")).withColumn("cy", along("y")).withColumn("cz", along("z")).withColumn("cell", named(F.col("level"), "cx", "cy", "cz"))
    wanted = q.groupBy("deal").agg(F.collect_set(F.struct("level", "size")).alias("levels"))
    orbit = orbits.select("id", "a_km", "inc", "raan", "phase")
    if orbits.count() <= most:
        orbit = F.broadcast(orbit)
        met = wanted.crossJoin(orbit)
    else:
        met = orbit.crossJoin(F.broadcast(wanted)).repartition(tasks, "deal")
    placed = states_at(met.withColumn("k", k), step_s, ["deal", "levels"]).select("deal", "id", F.explode("levels").alias("of"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    placed = placed.select("deal", "id", "ox", "oy", "oz", named(F.col("of.level"), *[F.floor(F.col(f"o{c}") / F.col("of.size")) for c in "xyz"]).alias("cell"))
    apart = lambda a, b: reduce(lambda x, y: x + y, [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"])
    same = reduce(lambda x, y: x & y, [F.floor(F.col(f"o{c}") / F.col("size")) == F.col(f"c{c}") for c in "xyz"])
    both = placed.join(probes.hint("shuffle_hash"), ["deal", "cell"]).where((apart("", "o") <= F.col("reach") * F.col("reach")) & same)
    both = both.select("deal", *keys, "id", F.col("t_s").alias("k"), F.struct("x", "y", "z", "radius_km").alias("at")).join(orbit, "id")
    exact = states_at(both, 1.0, keep=["deal", *keys, "at"])
    exact = _settled(exact.withColumn("distance_km", F.sqrt(apart("", "at."))).select("deal", *keys, "id", "distance_km", F.col("at.radius_km").alias("__radius")))
    return exact.where("distance_km <= __radius").drop("__radius")


def near_points(queries: DataFrame, objs: DataFrame, step_s: float = 60.0, most: int = 500_000) -> DataFrame:
    """q, id, distance_km of all objects within each query's own radius at the query's own time.

    ``queries`` has q, t_s, x, y, z, radius_km; ``objs`` are circular orbits. The search is over different orbits (``near_orbits``),
    and what is near is named by all objects of its orbit, where no pair moves.
    """
    first, names = copies(objs)
    q, layout = dealt_by_step(queries, "q", step_s)
    with dealt_by_part(objs.sparkSession):
        near = checkpoint(near_orbits(q, first, layout, ["q"], step_s, most).select("q", F.col("id").alias("one"), "distance_km"))
    return near.join(names, "one").select("q", "id", "distance_km")


def contained(sets: DataFrame, holders: DataFrame) -> DataFrame:
    """s, h of every set (rows s, element) whose elements all are in a holder (rows h, element).

    Holders are numbered, and an element has one row for 64 of them, a word whose bits say which hold it. So a set meets
    words, not holders, and only those that its element with the fewest words has: what they have in common with the
    words of its other elements are the holders of the whole set.
    """
    sets = sets.distinct()
    numbered = checkpoint(holders.select("h").distinct().withColumn("at", F.monotonically_increasing_id()))
    numbered = F.broadcast(numbered) if numbered.count() <= 1_000_000 else numbered
    word, bit = F.floor(F.col("at") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = checkpoint(holders.join(numbered, "h").groupBy("element", word).agg(F.bit_or(bit).alias("bits")))
    held = words.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    known = checkpoint(sets.join(held, "element", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    rarest = known.groupBy("s").agg(F.min_by("element", F.struct("n", "element")).alias("element"), F.min("n").alias("least"), F.count(F.lit(1)).alias("size")).where("least > 0")
    first = rarest.join(words, "element").select("s", "word", "bits", "size", F.col("element").alias("probe"))
    rest = first.select("s", "word", "size", "probe").join(known.select("s", "element"), "s").where("element <> probe").join(words, ["element", "word"])
    met = first.select("s", "word", "bits", "size").unionByName(rest.select("s", "word", "bits", "size"))
    whole = met.groupBy("s", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("met"), F.max("size").alias("size")).where("met = size AND bits <> 0")
    at = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1L) = 1L)"))
    return whole.select("s", "word", at.alias("i")).withColumn("at", F.col("word") * 64 + F.col("i")).join(numbered, "at").select("s", "h")


def pair_minima(samples: DataFrame, step_s: float, rounds: int = 60) -> DataFrame:
    """pair, t_s, d_km of every local minimum of sampled pairs of tracks that can be the least of its pair, with its lower bound.

    ``samples`` has pair, k and the relative state dx..dz, dvx..dvz. Between two samples the relative track
    is the cubic through both states. A sampled minimum with the two intervals beside it is kept if its
    distance less the closing speed times the step does not exceed the least distance sampled of the pair:
    the others are pruned by that bound. Kept ones are narrowed by golden section. Samples are dealt by pair
    and sorted once; samples that come dealt by pair are not moved.
    """
    d = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"]))
    speed = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"dv{c}") * F.col(f"dv{c}") for c in "xyz"]))
    w = Window.partitionBy("pair").orderBy("k")
    state = F.struct("k", *[f"d{c}" for c in "xyz"], *[f"dv{c}" for c in "xyz"])
    rows = samples.withColumns({"d": d, "speed": speed, "own": state}).withColumns({"dl": F.lag("d").over(w), "dr": F.lead("d").over(w), "left": F.lag("own").over(w), "right": F.lead("own").over(w)})
    low = (F.col("dl").isNull() | (F.col("d") <= F.col("dl"))) & (F.col("dr").isNull() | (F.col("d") <= F.col("dr")))
    whole = Window.partitionBy("pair")
    found = rows.withColumns({"low": low, "bound": F.col("d") - F.col("speed") * step_s})
    found = found.withColumns({"least": F.min(F.when(F.col("low"), F.col("d"))).over(whole), "minima": F.count_if("low").over(whole)})
    kept = checkpoint(found.where("low AND bound <= least").select("pair", "own", "left", "right", "bound", "minima"))

    sides = {"own": "", "left": "_l", "right": "_r"}
    flat = kept.select("pair", "bound", "minima", *[F.col(f"{side}.{c}").alias(f"{c}{end}") for side, end in sides.items() for c in ("k", *_STATE)])
    return flat.mapInArrow(lambda batches: _narrowed(batches, step_s, rounds), "pair long, t_s double, d_km double, bound double, minima long")


_STATE = [f"d{v}{c}" for v in ("", "v") for c in "xyz"]


def _narrowed(batches: Iterator[pa.RecordBatch], step_s: float, rounds: int) -> Iterator[pa.RecordBatch]:
    """The minima of a batch, narrowed by golden section over the interval on each side that there is."""
    g = (5**0.5 - 1) / 2
    for batch in batches:
        col = lambda n: batch.column(n).to_numpy(zero_copy_only=False).astype(float)
        own, left, right = ([col(f"{c}{end}") for c in _STATE] for end in ("", "_l", "_r"))

        def at(t: np.ndarray) -> np.ndarray:
            """Distance at a time around the sample, in steps from it (-1 to 1)."""
            after = t >= 0
            u = np.where(after, t, t + 1)
            h00, h10 = (1 + 2 * u) * (1 - u) * (1 - u), u * (1 - u) * (1 - u)
            h01, h11 = u * u * (3 - 2 * u), u * u * (u - 1)
            a, b = ([np.where(after, x, y) for x, y in zip(*pair, strict=True)] for pair in ((own, left), (right, own)))
            ends = [h00 * a[i] + h10 * step_s * a[i + 3] + h01 * b[i] + h11 * step_s * b[i + 3] for i in range(3)]
            # a sample without a neighbour on one side stands at 0, where that side's weights are 0
            alone = np.isnan(ends[0])
            return np.sqrt(sum(np.where(alone, own[i], x) ** 2 for i, x in enumerate(ends)))

        low, high = np.where(np.isnan(col("k_l")), 0.0, -1.0), np.where(np.isnan(col("k_r")), 0.0, 1.0)
        for _ in range(rounds):
            p, q = high - g * (high - low), low + g * (high - low)
            closer = at(p) <= at(q)
            low, high = np.where(closer, low, p), np.where(closer, q, high)
        t = (low + high) / 2
        yield pa.RecordBatch.from_arrays([batch.column("pair").cast(pa.int64()), pa.array((col("k") + t) * step_s), pa.array(at(t)), batch.column("bound"), batch.column("minima").cast(pa.int64())], names=["pair", "t_s", "d_km", "bound", "minima"])


def radii(points: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, n, p50_km, p90_km: distances of points (x, y, z) from the centroid of their key; keys of fewer than ``least`` points are left out."""
    c = points.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"], F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    off = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    d = points.join(c, keys).select(*keys, F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("__d"))
    return histogram_quantiles(d, keys, "__d", [0.5, 0.9]).withColumnsRenamed({"q0": "p50_km", "q1": "p90_km"})
