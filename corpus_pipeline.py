"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing to source weights, BPE encoding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns
of ``docs``; the last returns token ids. Only documents that a stage rejects go; extra columns pass
through, also under names that the operators use themselves. Null and empty texts fail the quality
rules; a stage called on its own treats null as empty. Null ids count as ids of their own that sort last,
ids may repeat with different texts, and an empty table passes as an empty table.

``run`` writes each stage's output once, to the shared folder, so that the eager jobs of the next stage
do not compute it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apsidal.llm.bpe import bpe_encode
from apsidal.llm.common import read, stored
from apsidal.llm.exact_dedup import drop_exact_copies
from apsidal.llm.mixing import take_mix
from apsidal.llm.quality import keep_quality
from apsidal.llm.queries import rank_file
from apsidal.llm.simhash_dedup import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the likelihood ratio.

    Every row is judged by its own text, so repeated rows and null ids stay or go like any other; null and
    empty texts go. At equality with a threshold a document stays.
    """
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical normalised texts.

    The smallest id stays, null ids last; of rows equal in id and text one stays. All null and empty texts
    are one group.
    """
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints within two bits.

    The smallest id stays, null ids last, then the smallest text hash. All texts without words are one
    group.
    """
    return drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its copies under the target weights say (0, 1 or 2 times).

    A null source is a source of its own, ranked last; texts without words are taken once. Which of equally
    long documents get a copy more is decided by id hash, so repeated ids tie and either may.
    """
    return take_mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, ends: one row per row of the mix, repeats and null ids included; no text, no ids."""
    return bpe_encode(docs, rank_file())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]

#: Iterative stages and Newton solves have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
