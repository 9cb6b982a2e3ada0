"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a document's hash. Starting from one bucket, only buckets
over the byte limit split on one more bit, until every shard fits. The split of a bucket depends on its
bytes alone, so the directory is worked out on a histogram of hash cells and not by moving documents:
the depth of a cell's shard is the first depth whose prefix fits the limit.

Scale: one map-side combined aggregate over (cell, bytes), a small aggregate over prefixes, and one join
of documents with the directory, which is broadcast only after counting it. The join is on one prefix of
the hash, of the shallowest shard's length; the few shards under that prefix come as one array, so no
document is repeated. Cells that do not fit at the histogram's depth are refined in further rounds over
their documents only. Repeats of one document, which no bit of a hash parts, go on splitting by the low
bits of their occurrence number, so their shards fit the limit too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, sized_broadcast, stored

#: Bits of the hash; production limit of a shard in UTF-8 bytes of text.
HASH_BITS = 60
LIMIT_BYTES = 1 << 20
#: Bits that a round of the histogram looks at.
ROUND_BITS = 15


def key_hash(*cols: Column) -> Column:
    """The first 60 bits of an MD5 over the key columns, as a non-negative long."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(F.encode(joined, "UTF-8")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, bits: int | Column) -> Column:
    """The leading bits of a hash."""
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - bits).cast("int"))


def directory(keys: DataFrame, limit: int = LIMIT_BYTES, round_bits: int = ROUND_BITS) -> DataFrame:
    """shard_prefix, depth, shard_bytes, n_docs of all shards from (h, bytes), one row per document.

    A shard over the limit remains only where one document is longer than the limit, or where all its
    documents share all bits (repeats of one document), which ``assign_shards`` parts by occurrence.
    """
    found, done = None, 0
    left = keys
    while True:
        to = min(done + round_bits, HASH_BITS)
        cells = checkpoint(left.groupBy(prefix(F.col("h"), to).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
        depths = F.sequence(F.lit(done), F.lit(to))
        levels = cells.select("cell", "bytes", "n", F.explode(depths).alias("depth"))
        levels = levels.groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(to) - F.col("depth")).alias("shard_prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("n_docs") == 1) | (F.col("depth") == HASH_BITS)
        levels = levels.withColumn("fits", fits)
        # a prefix is a shard if it fits and its parent does not; parents are one depth up
        parents = levels.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("shard_prefix") * 2, F.col("shard_prefix") * 2 + 1)).alias("shard_prefix"))
        split = levels.where("fits").join(parents, ["depth", "shard_prefix"], "left_semi")
        root = levels.where(F.col("fits") & (F.col("depth") == 0)) if done == 0 else None
        leaves = split if root is None else split.unionByName(root)
        leaves = checkpoint(leaves.select("shard_prefix", "depth", "shard_bytes", "n_docs"))
        found = leaves if found is None else found.unionByName(leaves)
        if to == HASH_BITS:
            return found
        over = checkpoint(levels.where(~F.col("fits") & (F.col("depth") == to)).select(F.col("shard_prefix").alias("over")))
        n = over.count()
        if not n:
            return found
        left, done = left.join(sized_broadcast(over, n), prefix(F.col("h"), to) == F.col("over"), "left_semi"), to


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES, keep: list[str] | None = None, round_bits: int = ROUND_BITS) -> DataFrame:
    """doc_id (or ``keep``), bytes, shard (its bits, empty for the only shard), depth, shard_bytes, shard_docs.

    The key is the id and the text, so documents that share an id still part. Null and empty texts have
    0 bytes and null ids hash as empty. Repeated rows part by their occurrence number once a shard of
    them exceeds the limit; which of them gets which number is of no matter. An empty table has no shards.
    """
    names = ["doc_id"] if keep is None else keep
    cols = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*cols, key_hash(F.col(id_col), F.md5(F.encode(text, "UTF-8"))).alias("h"), F.octet_length(text).cast("long").alias("bytes"))
    # texts are read and hashed once for the directory; without columns to keep that is all that is read of them
    keys = stored(rows if keep is None else rows.select("h", "bytes"))
    rows = keys if keep is None else rows
    shards = checkpoint(directory(keys.select("h", "bytes"), limit, round_bits))
    base, n = shards.agg(F.coalesce(F.min("depth"), F.lit(0)), F.count(F.lit(1))).first()
    book = shards.select(prefix_of("shard_prefix", "depth", base).alias("__cell"), F.struct("depth", "shard_prefix", "shard_bytes", F.col("n_docs").alias("shard_docs")).alias("s"))
    book = book.groupBy("__cell").agg(F.collect_list("s").alias("__shards"))
    mine = lambda s: F.call_function("shiftright", F.col("h"), F.lit(HASH_BITS) - s["depth"]) == s["shard_prefix"]
    met = rows.withColumn("__cell", prefix(F.col("h"), base)).join(sized_broadcast(book, n), "__cell")
    met = met.select(*names, "h", "bytes", F.filter("__shards", mine)[0].alias("__s"))  # no shard is the prefix of another
    out = met.select(*names, "bytes", bits(F.col("__s.shard_prefix"), F.col("__s.depth")).alias("shard"), F.col("__s.depth").alias("depth"), "__s.shard_bytes", "__s.shard_docs", "h")
    over = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    if shards.withColumn("shard_docs", F.col("n_docs")).where(over).isEmpty():
        return out.drop("h")
    return out.where(~over).drop("h").unionByName(_repeats_parted(out.where(over), names, limit))


def prefix_of(shard_prefix: str, depth: str, base: int) -> Column:
    """The first ``base`` bits of a shard's prefix, which has as many at least."""
    return F.call_function("shiftright", F.col(shard_prefix), F.col(depth) - F.lit(base))


def bits(value: Column, width: Column) -> Column:
    """The binary digits of a number; none for width 0."""
    return F.when(width > 0, F.lpad(F.conv(value.cast("string"), 10, 2), width, F.lit("0"))).otherwise(F.lit(""))


def _repeats_parted(rows: DataFrame, names: list[str], limit: int) -> DataFrame:
    """Split the shards of repeated documents by low bits of the occurrence number, one bit after another.

    Numbers come from counts per input partition and row numbers within it, so the repeats of one
    document are not gathered in one task.
    """
    rows = checkpoint(rows.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    counts = rows.groupBy("h", part.alias("__part")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("h", "__part", (F.sum("c").over(Window.partitionBy("h").orderBy("__part")) - F.col("c")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("h", "__part").orderBy("__row"))
    rows = rows.withColumn("__part", part).withColumn("nth", nth).join(before, ["h", "__part"]).withColumn("nth", F.col("nth") - 1 + F.col("before"))
    # the first width of which no occurrence class is over the limit; a class that fits one bit earlier stays there
    room = F.greatest(F.floor(F.lit(limit) / F.col("bytes")), F.lit(1))
    width = F.greatest(F.ceil(F.log2(F.col("shard_docs") / room)), F.lit(0)).cast("int")
    classes = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(width - 1, F.lit(0)))
    size = lambda step: F.floor((F.col("shard_docs") - 1 - F.pmod("nth", step)) / step) + 1
    early = (width > 0) & (size(classes) <= room)
    rows = rows.withColumn("__depth", F.when(early, width - 1).otherwise(width))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__depth"))
    own = F.reverse(bits(F.pmod("nth", step), F.col("__depth")))
    out = rows.select(*names, "bytes", F.concat("shard", own).alias("shard"), (F.col("depth") + F.col("__depth")).alias("depth"), (size(step) * F.col("bytes")).alias("shard_bytes"), size(step).alias("shard_docs"))
    return out


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write documents as one folder per shard; a shard's rows meet in one task, which its limit bounds.

    All rows and columns are written, nulls, repeats and empty texts too; a column named ``shard`` gives
    way to the shard's bits (the folder of the only shard is that of the empty string).
    """
    used = [how.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"))]
    whole = docs.select(*map(F.col, used), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("__doc"))
    out = assign_shards(whole, keep=["__doc"], **how)
    out.select("__doc.*", "shard").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
