"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate in (0, 2): the expected number of copies. Among all rates that meet the token
target of every source, the ones closest in (binary) entropy to one copy each are exponential tilts,
``2 * e^(λz) / (1 + e^(λz))`` with z the document's size over its source's mean size. The multipliers λ,
one per source, solve the convex dual; its gradient and Hessian are sums over documents, so each Newton
step is a distributed aggregate. Rates are then rounded to 0, 1 or 2 copies.

Scale: documents of one source and one size have the same rate, so the dual is solved over the
histogram (source, size, count), which one map-side combined aggregate makes over the written sizes; for rates the text
is read once, and never shuffled. Rounding walks the distinct sizes of a source from large to small and carries the
error, so a source ends within about its smallest document of its target. Which of equal documents get
the larger number of copies is decided by id hash, ranked in buckets of bounded size, so a source that
holds a third of all rows is not gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_on, sized_broadcast, words

#: Production parameters: weights by rank of the source, share of all words, most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
#: Rows that one ranking bucket holds on average at most.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target of a table (source, source_size): weighted shares under a cap.

    Sources rank by code point, null last, and take the weights in turn. A source whose share exceeds
    ``cap`` times its size stops there and the excess goes to the others by weight until none is above:
    the fixed point has one level t with target = min(cap * size, t * weight), found by rounds of one-row
    aggregates. One row per source; no task sees them all.
    """
    rows = ranked(sizes, F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = checkpoint(rows.withColumn("w", w).withColumn("stop", F.col("source_size") * float(cap)).drop("rank"))
    words = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:  # each round only adds sources that stop
        stop = F.col("stop") <= F.lit(level) * F.col("w")
        held, free, n = rows.agg(F.coalesce(F.sum(F.when(stop, F.col("stop"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stop, F.col("w"))), F.lit(0.0)), F.count_if(stop)).first()
        if n == stopped or not free:
            break
        level, stopped = (words - held) / free, n
    return rows.select("source", "source_size", F.when(F.lit(free == 0), F.col("stop")).otherwise(F.least("stop", F.lit(level) * F.col("w"))).alias("target"))


def ranked(df: DataFrame, order: Column) -> DataFrame:
    """Add ``rank``, from 0: a distributed sort, then row numbers from the sizes of its partitions."""
    rows = checkpoint(df.orderBy(order).withColumn("rank", F.monotonically_increasing_id()))
    part = F.shiftright("rank", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row per partition
    return rows.join(F.broadcast(before), part == F.col("__part")).withColumn("rank", F.col("__before") + F.col("rank").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before")


def _tilted(lam: Column, z: Column) -> Column:
    """Share of the most copies under the tilt, in (0, 1); the exponent is kept in range."""
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def solve_tilts(hist: DataFrame, targets: DataFrame, cap: int = MAX_COPIES, rounds: int = 12, steps: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """source, mean, lam: safeguarded Newton on the dual, ``steps`` steps per materialised round.

    A Newton step that would leave the bracket is replaced by the bracket's middle, so every source
    converges. A target at the cap needs an infinite multiplier; it gets the largest one.
    """
    big = 600.0
    state = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = join_on(state, targets, ["source"]).select("source", "mean", "target", "source_size")
    state = state.withColumns({"lam": F.lit(0.0), "lo": F.lit(-big), "hi": F.lit(big), "gap": F.lit(float("inf"))})
    state = state.withColumn("full", F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12))
    state = checkpoint(state)
    n = state.count()
    for _ in range(rounds):
        for _ in range(steps):
            known = sized_broadcast(state, n)
            z = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
            p = _tilted(F.col("lam"), z)
            held = ["mean", "target", "source_size", "lam", "lo", "hi", "gap", "full"]
            grad, curve = F.col("n") * F.col("size") * cap * p, F.col("n") * F.col("size") * z * cap * p * (F.lit(1.0) - p)
            state = join_on(hist, known, ["source"]).groupBy("source").agg(F.sum(grad).alias("got"), F.sum(curve).alias("slope"), *[F.first(c).alias(c) for c in held])
            over = F.col("got") - F.col("target")
            state = state.withColumns({"gap": F.abs(over), "lo": F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(over >= 0, F.col("lam")).otherwise(F.col("hi")), "newton": F.col("lam") - over / F.when(F.col("slope") > 0, F.col("slope"))})
            mid = (F.col("lo") + F.col("hi")) / 2
            state = state.withColumn("lam", F.when(F.col("full"), F.lit(big)).when(F.col("newton").between(F.col("lo"), F.col("hi")), F.col("newton")).otherwise(mid)).drop("got", "slope", "newton")
        state = checkpoint(state)
        if state.where(~F.col("full") & (F.col("gap") > F.greatest(F.lit(0.5), F.col("target") * tolerance))).isEmpty():
            break
    else:
        raise RuntimeError("the dual did not converge; allow more rounds")
    return state.select("source", "mean", F.round("lam", 9).alias("lam"), "full")  # rid of the order of sums


def _rounded(rates: DataFrame, cap: int) -> DataFrame:
    """source, size, n, copies: whole copies per (source, size), error carried from large to small sizes.

    A source's distinct sizes are one array; it is folded in blocks so that the fold copies little.
    """
    block = 256
    items = rates.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("size"), F.col("n"), F.col("rate"))), asc=False).alias("items"))
    items = items.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / F.lit(block)).cast("int")), lambda b: F.slice("items", b * block + 1, block)))

    def copies(err: Column, it: Column) -> Column:
        want = (it["n"] * it["rate"] * it["size"] + err) / it["size"]
        return F.greatest(F.lit(0.0), F.least(F.floor(want + 0.5).cast("double"), it["n"] * F.lit(float(cap))))

    def one(acc: Column, it: Column) -> Column:
        k = copies(acc["err"], it)
        return F.struct((acc["err"] + it["n"] * it["rate"] * it["size"] - k * it["size"]).alias("err"), F.concat(acc["out"], F.array(k.cast("long"))).alias("out"))

    none = F.array().cast("array<bigint>")

    def many(acc: Column, b: Column) -> Column:
        got = F.aggregate(b, F.struct(acc["err"].alias("err"), none.alias("out")), one)
        return F.struct(got["err"].alias("err"), F.concat(acc["outs"], F.array(got["out"])).alias("outs"))

    folded = F.aggregate("blocks", F.struct(F.lit(0.0).alias("err"), F.array().cast("array<array<bigint>>").alias("outs")), many)
    flat = items.select("source", "items", F.flatten(folded["outs"]).alias("copies"))
    return flat.select("source", F.explode(F.arrays_zip("items", "copies")).alias("x")).select("source", "x.items.size", "x.items.n", "x.copies")


def mix_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id (or the columns ``keep``), size, source_size, target, rate, copies, taken.

    Null text has size 0 and is taken once with no words (rate 1); a null source is a source of its own,
    ranked last. Documents of a source whose texts are all empty get target 0. Repeated rows count each.
    Reruns agree: equal documents are told apart by id hash only.
    """
    names = ["doc_id"] if keep is None else keep
    cols = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(f"`{c}`") for c in keep]
    size = F.size(words(F.col(text_col))).cast("long")
    sized = lambda extra: docs.select(*extra, F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size.alias("size"))
    narrow = checkpoint(sized([]))
    hist = checkpoint(narrow.groupBy(F.col("__source").alias("source"), "size").agg(F.count(F.lit(1)).alias("n")))
    targets = checkpoint(source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap))
    n_sources = targets.count()
    tilts = sized_broadcast(solve_tilts(hist, targets, cap), n_sources)
    z = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
    rates = join_on(hist, tilts, ["source"]).select("source", "size", "n", F.when(F.col("full"), F.lit(float(cap))).otherwise(_tilted(F.col("lam"), z) * cap).alias("rate"))
    whole = _rounded(rates.where("size > 0"), cap)
    plan = join_on(rates, whole.select("source", "size", "copies"), ["source", "size"], "left")
    spot = sized_broadcast(targets, n_sources)
    plan = join_on(plan, spot, ["source"]).select(F.col("source").alias("__s"), F.col("size").alias("__z"), "n", "rate", F.coalesce("copies", "n").alias("total"), "source_size", "target", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    plan = checkpoint(plan)
    n_plan = plan.count()
    known = sized_broadcast(plan, n_plan)
    met = lambda rows: rows.join(known, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
    # the total of a (source, size) gives every document total div n copies, and one more to the first by hash
    spread = F.col("total") % F.col("n")
    split = (spread > 0).alias("__split")
    bucket = F.pmod(F.xxhash64("__id"), F.col("buckets")).alias("__b")
    rows = met(narrow.withColumn("doc_id", F.col("__id")) if keep is None else sized(cols))
    rows = rows.select(*names, "__id", "__s", "size", "source_size", "target", "rate", "n", "total", split, bucket, F.xxhash64(F.lit("rank"), "__id").alias("__h"))
    even = rows.where(~F.col("__split")).withColumn("extra", F.lit(0))
    odd = rows.where("__split")
    # rows before a bucket, from bucket counts; then rows before a document within its bucket
    sums = checkpoint(met(narrow).where(spread > 0).select("__s", "size", bucket).groupBy("__s", "size", "__b").agg(F.count(F.lit(1)).alias("c")))
    before = sums.select("__s", "size", "__b", (F.sum("c").over(Window.partitionBy("__s", "size").orderBy("__b")) - F.col("c")).alias("before"))
    before = sized_broadcast(before, sums.count())
    odd = odd.withColumn("rn", F.row_number().over(Window.partitionBy("__s", "size", "__b").orderBy("__h", F.col("__id"))))
    odd = join_on(odd, before, ["__s", "size", "__b"])
    odd = odd.withColumn("extra", F.when(F.col("before") + F.col("rn") <= F.col("total") % F.col("n"), 1).otherwise(0)).drop("rn", "before")
    out = even.unionByName(odd)
    copies = (F.floor(F.col("total") / F.col("n")) + F.col("extra")).cast("long")
    return out.select(*names, "size", "source_size", F.col("target").cast("double").alias("target"), "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns of ``docs``."""
    used = [how.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]
    whole = docs.select(*map(F.col, used), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    mixed = mix_rates(whole, keep=["__doc"], **how)
    return mixed.where("copies > 0").select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__doc.*")
