"""Quality rules: counting rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The words and word pairs of a text are hashed into ``buckets`` cells. A multinomial over the cells is
estimated from the whole raw corpus and one from trusted target documents; the score of a document is
its log-likelihood ratio between the two, divided by its number of n-grams, and a fixed threshold
decides. Every document is counted and scored over its whole text.

Scale: the counts are one map-side combined aggregate that shuffles at most ``buckets`` rows a task;
the fitted weights (``buckets`` numbers) become a literal, so scoring is a narrow projection without
shuffle. The trusted documents are a bounded, documented sample of the labelled ones
(``trusted_limit``, those with the smallest id hashes), so their ids can be broadcast.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spaced

#: Parameters of the production rule.
BUCKETS = 1 << 15
TRUSTED_LIMIT = 20_000
THRESHOLD = -0.12
#: Words of a window of the repeat rule: three doublings of one word.
REPEAT_WINDOW = 8
#: Pseudo-occurrences of a cell, shared between target and rest as the corpus is: a cell that is seen
#: only a few times says little, so small corpora and rare words don't push documents either way.
PRIOR = 16.0


def _tokens(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep columns, __text, __flat (white space as spaces), __hash and __pairs (64-bit hashes of words and adjacent pairs)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flat = docs.select(*keep, text.alias("__text"), spaced(text).alias("__flat"))
    flat = flat.withColumn("__hash", F.transform(F.array_remove(F.split("__flat", " "), ""), lambda w: F.xxhash64(w)))
    return flat.withColumn("__pairs", _joined("__hash", 1))


def _joined(runs: str, by: int) -> Column:
    """Hashes of runs of 2 * by words from hashes of runs of by words."""
    n = F.greatest(F.size(runs) - by, F.lit(0))
    return F.zip_with(F.slice(runs, F.lit(1), n), F.slice(runs, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _cells(buckets: int) -> Column:
    """Cells of the words and of the pairs of adjacent words."""
    return F.transform(F.concat("__hash", "__pairs"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """doc_id of trusted documents: labelled quality 1 and never 0; at most ``limit``, by id hash."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, limit: int = TRUSTED_LIMIT, prior: float = PRIOR) -> list[float] | None:
    """Log ratio of each cell, target over raw; None if there is no trusted document with a word."""
    marked = docs.join(F.broadcast(trusted_ids(labels, limit).select(F.col("doc_id").alias("__id"), F.lit(1).alias("__t"))), docs[id_col] == F.col("__id"), "left").select(docs[text_col].alias("__raw"), F.coalesce("__t", F.lit(0)).alias("__t"))
    cells = _tokens(marked, "__raw", ["__t"]).select("__t", F.explode(_cells(buckets)).alias("cell"))
    counts = {r.cell: (r.n, r.t) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("__t").alias("t")).collect()}
    raw, target = sum(n for n, _ in counts.values()), sum(t for _, t in counts.values())
    if not target:
        return None
    share = target / raw
    return [round(math.log((t + prior * share) / (n + prior) / share), 4) for n, t in (counts.get(c, (0, 0)) for c in range(buckets))]


def base_rules(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """Counting rules over the columns of ``_tokens``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    k = REPEAT_WINDOW
    n = F.size("__hash")
    tokens = tokens.withColumn("__fours", _joined("__pairs", 2)).withColumn("__grams", _joined("__fours", 4))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = tokens.select(
        *keep,
        "__hash",
        "__pairs",
        n.cast("long").alias("n_words"),
        F.char_length(F.replace(F.col("__flat"), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        "__grams",
    )
    step = step.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__order": F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))}).drop("__lines", "__grams")
    again = lambda x, i: (F.get("__order", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("__order", i + 1)["h"].eqNullSafe(x["h"]))
    step = step.withColumn("__starts", F.sort_array(F.transform(F.filter("__order", again), lambda x: x["i"]))).drop("__order")
    covered = F.aggregate(F.transform("__starts", lambda p, i: F.least(F.coalesce(F.get("__starts", i + 1) - p, F.lit(k)), F.lit(k))), F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__starts")
    return step.withColumn("base_failed", (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words")))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, limit: int = TRUSTED_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), the counting rules, llr, base_failed, kept: one row per document.

    Null and empty texts have no words and fail the base rule. ``llr`` is null for them, and for all
    documents when no trusted document exists; the verdict is then that of the base rule alone.

    The row number, which is never negative, keeps the optimizer from inlining the whole rule into a
    filter on the result several times over (predicates do not move below a nondeterministic projection).
    """
    weights = fit_ratio(docs, labels, id_col, text_col, buckets, limit)
    cols = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    names = ["doc_id"] if keep is None else keep
    renamed = docs.select(*cols, F.col(text_col).alias("__raw"))
    rules = base_rules(_tokens(renamed, "__raw", names), names)
    if weights is None:
        llr = F.lit(None).cast("double")
    else:
        table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
        rules = rules.withColumn("__cells", _cells(buckets))
        total = F.aggregate("__cells", F.lit(0.0), lambda a, c: a + F.get(table, c))
        llr = F.when(F.size("__cells") > 0, total / F.greatest(F.size("__cells"), F.lit(1)))
    out = rules.withColumn("llr", llr).drop("__hash", "__pairs", "__cells")
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(True)))
    return out.withColumn("__row", F.monotonically_increasing_id()).where("__row >= 0").drop("__row")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that pass, with all their columns: a filter over the same projection, no join back."""
    whole = docs.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    marked = quality_verdicts(whole, labels, id_col, text_col, keep=["__doc"], **how)
    return marked.where("kept").select("__doc.*")
