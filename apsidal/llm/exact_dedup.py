"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size blocks. Equal blocks get the same integer name, different
blocks different names: the name of a block is the smallest occurrence (row, position) among the
occurrences that a sort brings together. Adjacent names are then paired and the pairs named in the
same way, round by round, until every document carries a single name. Names are assigned by comparing
whole blocks and whole pairs, so two documents share (number of blocks, name) if and only if their
normalised texts are identical: there is no hash whose collisions could merge documents.

Scale: the text is shuffled once, by block; later rounds move integers only and there are
``log2(longest text / block_chars)`` of them. A block or pair that occurs very often (copies, a
passage that many documents share) is named through an aggregate with map-side combine instead of
being gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sized_broadcast, squeezed, with_group_aggs


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the key columns by the name of their value: two integers, row and position of its first occurrence."""
    return with_group_aggs(rows, keys, {"name": F.min(F.struct("uid", "pos"))}).drop(*keys)


def exact_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """uid, doc_id, text_sha256, n_blocks, name: one row per document; (n_blocks, name) is its identity.

    Null and empty texts are the empty text, which is one empty block. ``uid`` numbers the rows of the
    input, so repeated ids and repeated rows stay apart. Extra columns of ``docs`` are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), squeezed(F.col(text_col)).alias("norm"), F.monotonically_increasing_id().alias("uid"))
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))  # one pass, however long the text
    src = src.select("uid", "doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"), F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut).alias("blocks"))
    blocks = src.select("uid", "doc_id", "sha", F.size("blocks").cast("long").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    first = F.col("pos") == 0
    blocks = blocks.select("uid", "n_blocks", F.col("pos").cast("long").alias("pos"), F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "block")
    level = checkpoint(_named(blocks, ["block"]))
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    done = level.where("n_blocks = 1")
    out = done.select("uid", "doc_id", "sha", "n_blocks", "name")
    length = 1
    level = level.where("n_blocks > 1")
    while length < longest:
        pairs = level.groupBy("uid", "n_blocks", F.expr("pos div 2").alias("pos")).agg(
            F.max("doc_id").alias("doc_id"),
            F.max("sha").alias("sha"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left_name"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.struct(F.lit(-1).cast("long").alias("uid"), F.lit(-1).cast("long").alias("pos"))).alias("right_name"),
        )
        level = checkpoint(_named(pairs, ["left_name", "right_name"]))
        length *= 2
        out = out.unionByName(level.where((F.col("n_blocks") > length // 2) & (F.col("n_blocks") <= length)).select("uid", "doc_id", "sha", "n_blocks", "name"))
        level = level.where(F.col("n_blocks") > length)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; null ids sort last and, among rows that repeat
    the same id, exactly one stays. An empty table gives an empty result.
    """
    ids = exact_identity(docs, id_col, text_col, block_chars)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
    rows = with_group_aggs(ids, ["n_blocks", "name"], {"best": best, "group_size": F.count(F.lit(1))})
    return rows.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the uid of the scan is not needed again.

    Rows are matched by id where ids are unique. Where an id repeats, or is null, its rows are
    told apart by the text as well, and of rows equal in both one stays.
    """
    dedup = exact_dedup(docs, id_col, text_col, block_chars)
    met = dedup.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    met = checkpoint(met.where("not stays or n > 1").select("__id", "__sha", "stays"))
    gone = sized_broadcast(met.select("__id", "__sha"), met.count())
    again = met.where("stays").select("__id", "__sha")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__own"), F.sha2(F.encode(squeezed(F.col(text_col)), "UTF-8"), 256).alias("__text"))
    same = lambda keys: F.col("__own").eqNullSafe(keys["__id"]) & (F.col("__text") == keys["__sha"])
    out = whole.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        out = out.unionByName(whole.join(again, same(again), "left_semi").dropDuplicates(["__own", "__text"]))
    return out.select("__doc.*")
