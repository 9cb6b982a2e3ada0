"""Ranks, correlations, quantiles, allocation and sampling over tables of any size."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encounters import floored
from .encounters import numbered
from .graph import checkpoint
from .ordered import placed


def average_ranks(values: DataFrame, keys: list[str], value: str, times: str | None = None) -> DataFrame:
    """keys, value, rank of every distinct value: ties share the mean of their ranks. A row may stand for ``times`` rows.

    Counts are aggregated by value first, then put in order by one distributed sort over all keys; running
    sums are taken inside the parts of that sort and carried over them by their totals, one row a part and
    key. So a key with most of the rows is spread over tasks like any other.
    """
    counts = values.groupBy(*keys, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    rows = checkpoint(counts.orderBy(*keys, value).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "__part").agg(F.sum("n").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    met = rows.withColumn("__upto", F.sum("n").over(own)).join(offsets, [*keys, "__part"])
    return met.select(*keys, value, (F.col("__before") + F.col("__upto") - (F.col("n") - 1) / 2).alias("rank"))


def pair_correlations(df: DataFrame, names: list[str], most: int = 200_000) -> DataFrame:
    """a, b, n, pearson, spearman of every pair of columns, over the rows where both are present.

    Rows are first counted by pair of columns and pair of values, so that values which many rows share meet
    their ranks once. Rank tables of up to ``most`` rows are broadcast, which no popular value can skew.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(names, 2)])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and y is not null")
    rows = checkpoint(rows.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("times")))

    def ranked(side: str) -> DataFrame:
        table = checkpoint(average_ranks(rows, ["a", "b"], side, "times").withColumnRenamed("rank", f"r{side}"))
        return F.broadcast(table) if table.count() <= most else table

    met = rows.join(ranked("x"), ["a", "b", "x"]).join(ranked("y"), ["a", "b", "y"])
    names4 = ("x", "y", "rx", "ry")
    means = met.groupBy("a", "b").agg(F.sum("times").alias("n"), *[(F.sum(F.col("times") * F.col(c)) / F.sum("times")).alias(f"m_{c}") for c in names4])
    off = {c: F.col(c) - F.col(f"m_{c}") for c in names4}
    product = lambda u, v: F.sum(F.col("times") * off[u] * off[v])
    corr = lambda u, v: product(u, v) / F.sqrt(product(u, u) * product(v, v))
    out = met.join(F.broadcast(means), ["a", "b"]).groupBy("a", "b", "n").agg(corr("x", "y").alias("p"), corr("rx", "ry").alias("s"))  # one row a pair of columns
    ok = F.col("n") >= 3
    return out.select("a", "b", "n", F.when(ok, floored(F.col("p"), 4)).alias("pearson"), F.when(ok, floored(F.col("s"), 4)).alias("spearman"))


def histogram_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 1024, most: int = 100_000) -> DataFrame:
    """keys, n and q0, q1, ... of the linearly interpolated quantiles, exact, without a buffer of a group's rows; nulls do not count.

    A part of a group that holds order statistics asked for and more than ``most`` rows is cut into
    equal-width bins between its bounds, and only the bins that hold some go on, round after round; so
    neither a large group nor an outlier leaves many rows to one task. A part of equal values is not ranked.
    The values are written once: a value out of sums, computed again in another order of its rows, could
    fall outside the bounds of its own part.
    """
    rows = checkpoint(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * s), F.ceil((F.col("n") - 1) * s)) for s in shares])))
    parts = checkpoint(rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("n")).withColumns({"c": F.col("n"), "before": F.lit(0).cast("long")}))
    open_part = (F.col("c") > most) & (F.col("lo") < F.col("hi"))

    def inside(some: DataFrame) -> DataFrame:
        """Rows with the part they lie in; the parts of a group are at most twice as many as the shares."""
        held = some.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "n", "c", "before")).alias("__parts"))
        own = F.get(F.filter("__parts", lambda p: (F.col("__v") >= p["lo"]) & (F.col("__v") <= p["hi"])), F.lit(0))
        return rows.join(held, keys).withColumn("__p", own).where("__p is not null").select(*keys, "__v", "__p.*")

    while not parts.where(open_part).isEmpty():
        put = F.least(F.floor((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1)).alias("__bin")
        counts = inside(parts.where(open_part)).groupBy(*keys, "lo", "n", "before", put).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = counts.withColumn("at", F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "lo").orderBy("__bin")) - F.col("c"))
        hit = upto.where(F.exists(wanted, lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("c"))))
        parts = checkpoint(parts.where(~open_part).unionByName(hit.select(*keys, F.col("low").alias("lo"), F.col("high").alias("hi"), "n", "c", F.col("at").alias("before"))))
    ranked = inside(parts.where("lo < hi")).withColumn("first", F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("__v")) - 1 + F.col("before"))
    near = ranked.select(*keys, "n", "__v", "first", F.col("first").alias("last")).unionByName(parts.where("lo = hi").select(*keys, "n", F.col("lo").alias("__v"), F.col("before").alias("first"), (F.col("before") + F.col("c") - 1).alias("last")))
    at = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("__v")))
    place = lambda s: (F.col("n") - 1) * s
    out = near.groupBy(*keys, "n").agg(*[x for i, s in enumerate(shares) for x in (at(F.floor(place(s))).alias(f"l{i}"), at(F.ceil(place(s))).alias(f"h{i}"))])
    return out.select(*keys, "n", *[(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (place(s) - F.floor(place(s)))).alias(f"q{i}") for i, s in enumerate(shares)])


def largest_remainder(strata: DataFrame, budget: int) -> DataFrame:
    """stratum, size, seats: shares of a budget by size, at least one each, whole parts first.

    Rounds over the strata in the order of their remainders (ties by stratum) give one seat each to those
    with room until the budget is spent; where the least of one seat overshoots, the largest stratum (ties:
    the first) gives seats back one by one. Both have closed forms: a number of full rounds found from
    counts by room, and a level down to which the largest are cut. Strata may be many; what the driver
    sees is one row a distinct room or seat count.
    """
    total = strata.agg(F.sum("size").alias("total"))
    quota = F.greatest(F.lit(1.0), F.lit(float(budget)) * F.col("size") / F.col("total"))
    rows = strata.crossJoin(F.broadcast(total)).withColumn("quota", quota)  # one row
    rows = rows.withColumn("base", F.least(F.floor("quota"), F.col("size"))).withColumn("rest", -(F.col("quota") - F.floor("quota")))
    given = rows.agg(F.sum("base")).first()[0] or 0
    if given > budget:
        level, spare = _cut_level(rows, given - budget)
        ranked = numbered(rows.withColumn("top", (F.col("base") < level).cast("int")), "top", "stratum")
        return ranked.select("stratum", "size", (F.least("base", F.lit(level)) - F.when((F.col("top") == 0) & (F.col("rn") < spare), 1).otherwise(0)).alias("seats"))
    rounds, last = _full_rounds(rows, budget - given)
    ranked = numbered(rows.withColumn("full", (F.col("size") - F.col("base") <= rounds).cast("int")), "full", "rest", "stratum")
    more = F.least(F.col("size") - F.col("base"), F.lit(rounds)) + F.when((F.col("full") == 0) & (F.col("rn") < last), 1).otherwise(0)
    return ranked.select("stratum", "size", (F.col("base") + more).alias("seats"))


def _full_rounds(rows: DataFrame, left: int) -> tuple[int, int]:
    """How many whole rounds can be given out, and how many seats are left for the next one."""
    rooms = rows.groupBy((F.col("size") - F.col("base")).alias("room")).agg(F.count(F.lit(1)).alias("n")).where("room > 0").orderBy("room").collect()
    open_now, done = sum(r.n for r in rooms), 0
    for r in rooms:
        rounds = min(r.room - done, left // open_now)
        left, done = left - rounds * open_now, done + rounds
        if done < r.room:
            return done, left
        open_now -= r.n
    return done, 0


def _cut_level(rows: DataFrame, over: int) -> tuple[int, int]:
    """The seat count that the largest strata are cut to, and how many of them lose one seat more."""
    counts = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("base")).collect()
    above, level = 0, counts[0].base
    for r, after in zip(counts, [*[c.base for c in counts[1:]], None], strict=True):
        above += r.n
        down = over // above if after is None else min(level - after, over // above)
        over, level = over - down * above, level - down
        if after is None or level > after:
            break
    return level, over


def evenly_spaced(rows: DataFrame, seats: DataFrame, order: list[str]) -> DataFrame:
    """The members of each stratum at ranks round(i * (n - 1) / (k - 1)) for k seats, i from 0 (one seat: the first)."""
    ranked = placed(rows, ["stratum"], order).withColumnRenamed("place", "__rn").drop("of")
    picks = seats.where("seats > 0").select("stratum", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), (F.col("seats") - 1).cast("int")), lambda i: F.when(F.col("seats") == 1, F.lit(0)).otherwise(F.floor(i * (F.col("size") - 1) / (F.col("seats") - 1) + 0.5)).cast("long")))).alias("__rn"))
    return ranked.join(picks, ["stratum", "__rn"]).drop("__rn")
