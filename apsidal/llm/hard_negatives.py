"""Hard-negative mining by blocked dense products of anchor blocks and candidate blocks.

Components become integers, so a score is an integer inner product: float64 holds it exactly below 2^53,
and blocks that could pass that bound are multiplied as Python integers. Anchors are packed into blocks
and broadcast a group of blocks at a time; a first pass over all rows keeps, per task and anchor, the best
rows of the same label, which merge in any order into the anchor's positives. These are broadcast again,
and a second pass keeps the best rows of other labels inside each positive's score window.

Scale: every pass is a narrow map over the rows with a bounded state; only the few best rows of each task
and anchor are shuffled, so labels and hot keys play no part. The driver holds one group of anchor blocks
(``GROUP_BYTES``) at a time, and each group's result is appended to a table in the shared folder.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Rows of an anchor block and of a candidate block.
ANCHOR_ROWS, CANDIDATE_ROWS = 256, 2048
#: Bytes of anchor blocks that are broadcast together.
GROUP_BYTES = 32 << 20
#: Integers up to here are exact in float64, sums included.
EXACT = 2.0**53
LONG = 2**63 - 1
#: Below the product of any two vectors.
NEVER = -(1 << 2200)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
SCALE = 256


def usable_rows(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    """The rows that take part and their components, each as floor(256 x) in float64."""
    lists = batch.column(2)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        values = np.floor(SCALE * values)
    good = np.isfinite(values) & ~np.asarray(flat.is_null())
    starts = lists.offsets.to_numpy()
    whole = np.concatenate(([0], np.cumsum(~good)))
    keep = (whole[starts[1:]] == whole[starts[:-1]]) & ~np.asarray(lists.is_null()) & ~np.asarray(batch.column(1).is_null())
    at = np.flatnonzero(keep)
    return batch.take(pa.array(at)), [values[a:b] for a, b in zip(starts[at], starts[at + 1], strict=True)]


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: int64 by a float64 product where the bound allows, Python integers beyond."""
    top = a.shape[1] * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)


class Best:
    """The first k (score desc, id asc, null ids last) of each of n lists, fed block by block."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.kept: list[list[tuple]] = [[] for _ in range(n)]
        self.bound: list = [None] * n

    def feed(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Entries of several lists; ``lists`` ascends."""
        if not len(lists):
            return
        order = np.lexsort((ids, null, -scores if scores.dtype != object else _descending(scores), lists))
        lists, scores, ids, null = lists[order], scores[order], ids[order], null[order]
        first = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
        for a, b in zip(first, np.append(first[1:], len(lists)), strict=True):
            n, b = int(lists[a]), min(b, a + self.k)
            more = [(-int(s), bool(z), int(i)) for s, z, i in zip(scores[a:b], null[a:b], ids[a:b], strict=True)]
            self.kept[n] = sorted(self.kept[n] + more)[: self.k]
            if len(self.kept[n]) == self.k:
                self.bound[n] = -self.kept[n][-1][0]

    def floor(self, lists: Iterable[int], exact: bool) -> np.ndarray:
        """The score that an entry of each of these lists must reach; below all scores while a list is short."""
        if exact:
            return np.array([NEVER if (b := self.bound[n]) is None else b for n in lists], object)
        return np.array([-LONG if (b := self.bound[n]) is None else max(-LONG, min(LONG, b)) for n in lists], np.int64)


def _descending(scores: np.ndarray) -> np.ndarray:
    """Ranks of Python integers, the largest first."""
    seen = {s: -i for i, s in enumerate(sorted(set(scores)))}
    return np.array([seen[s] for s in scores], np.int64)


def _saturated(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def pack_anchors(rows: DataFrame) -> DataFrame:
    """label array, ids, vectors (float64 bytes of one matrix), width: blocks of anchors, made where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            width = max((len(v) for _, _, v in held), default=0)
            cols = [pa.array([[i for i, _, _ in held]], pa.list_(pa.int64())), pa.array([[c for _, c, _ in held]], pa.list_(pa.int64())), pa.array([padded([v for _, _, v in held], width).tobytes()], pa.binary()), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays(cols, names=["ids", "labels", "vectors", "width"])

        for batch in batches:
            part, vectors = usable_rows(batch)
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), vectors, strict=True):
                held.append(row)
                if len(held) == ANCHOR_ROWS:
                    yield out()
                    held = []
        if held:
            yield out()

    return rows.mapInArrow(run, "ids array<long>, labels array<long>, vectors binary, width int")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, whether null, labels, vectors of candidate blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_ROWS):
            part, vectors = usable_rows(batch.slice(at, CANDIDATE_ROWS))
            if vectors:
                ids = part.column(0)
                null = np.asarray(ids.is_null())
                yield ids.fill_null(0).to_numpy(zero_copy_only=False), null, part.column(1).to_numpy(zero_copy_only=False), padded(vectors, max(map(len, vectors)))


def _scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Vectors of different lengths meet in their common components."""
    width = min(anchors.shape[1], vectors.shape[1])
    return products(anchors[:, :width], vectors[:, :width])


def _top(scores: np.ndarray, valid: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid entries that can be among the first k of their row."""
    if scores.dtype != object and floor.dtype != object and scores.shape[1] > k:
        low = np.iinfo(np.int64).min
        floor = np.maximum(floor, np.partition(np.where(valid, scores, low), -k, axis=1)[:, -k])
    return np.nonzero(valid & (scores >= floor[:, None]))


def _best_rows(src: DataFrame, group, k: int, windows=None) -> DataFrame:
    """no, pos, score, vec_id: the first k of each task for each list.

    Without windows a list is an anchor and takes rows of its label; with windows it is an anchor and one
    of its positives' scores and takes rows of other labels inside the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(np.array(labels, np.int64), np.frombuffer(raw).reshape(len(labels), width)) for _, labels, raw, width in group.value]
        caps = windows.value if windows is not None else None  # of each anchor, the ascending distinct scores
        first = np.concatenate(([0], np.cumsum([len(b[0]) for b in blocks]))).astype(int)
        width = 1 if caps is None else max((len(c) for c in caps), default=0)
        best = Best(int(first[-1]) * width, k)
        for ids, null, labels, vectors in _candidates(batches) if width else ():
            for (own, matrix), a in zip(blocks, first, strict=False):
                scores = _scores(matrix, vectors)
                if caps is None:
                    at, to = _top(scores, own[:, None] == labels[None, :], best.floor(range(a, a + len(own)), scores.dtype == object), k)
                    best.feed(a + at, scores[at, to], ids[to], null[to])
                    continue
                mine = caps[a : a + len(own)]
                high, low = [max(c, default=0) for c in mine], [-(-4 * min(c, default=1) // 5) for c in mine]
                kind = np.int64 if scores.dtype != object and all(abs(x) < LONG // 100 for x in (*high, *low)) else object
                inside = (own[:, None] != labels[None, :]) & (scores >= np.array(low, kind)[:, None]) & (scores <= np.array(high, kind)[:, None])
                at, to = np.nonzero(inside)
                if not len(at):
                    continue
                found = scores[at, to].astype(kind)
                for j in range(width):
                    cap = np.array([c[j] if j < len(c) else -1 for c in mine], kind)[at]
                    n = (a + np.arange(len(own))) * width + j
                    ok = (cap >= 0) & (80 * cap <= 100 * found) & (found <= cap)
                    ok &= found >= best.floor(n, kind is object)[at]
                    best.feed(n[at[ok]], found[ok], ids[to[ok]], null[to[ok]])
        flat = [(n // width, n % width, _saturated(-s), None if z else i) for n, kept in enumerate(best.kept) for s, z, i in kept]
        for at in range(0, len(flat), 1 << 16):
            part = flat[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["no", "pos", "score", "vec_id"])

    return src.mapInArrow(run, "no long, pos int, score long, vec_id long")


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The first k of each list over all tasks; Spark cuts to k before the shuffle too."""
    order = Window.partitionBy("no", "pos").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor row.

    ``anchors`` is a condition on the table's columns. Rows with a null label, a null vector or a null or
    non-finite component take no part, as anchors or as candidates. Null ids sort last among equal scores.
    A repeated row is a row of its own: an anchor's copy is one of its other rows, and each copy of an
    anchor has its own result. Vectors of different lengths are compared in the components they share.
    Scores beyond 64 bits saturate, and a saturated positive has the window of its saturated score. Positives with the same score
    have the same negatives. No anchors, or an empty table, give an empty result.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    blocks = stored(pack_anchors(src.where("anchor").select("vec_id", "label", "vector")))
    rows = src.select("vec_id", "label", "vector")
    path = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(path)
    for group in _groups(blocks, group_bytes):
        sent = spark.sparkContext.broadcast(group)
        # one place more than asked for: the anchor itself is among its candidates
        near = _merged(_best_rows(rows, sent, positives + 1), positives + 1).select("no", "score", "vec_id").orderBy("no", "place").toArrow().to_pylist()
        found = list(_positives(group, near, positives))
        caps: list[set[int]] = [set() for block in group for _ in block[0]]
        for no, _, score, _ in found:
            caps[no].add(score)
        windows = [sorted(c) for c in caps]
        held = spark.sparkContext.broadcast(windows)
        table = [(no, i, place, score, windows[no].index(score), anchor) for (no, place, score, i), anchor in zip(found, (_anchor_ids(group)[f[0]] for f in found), strict=True)]
        positive = spark.createDataFrame(table, "no long, positive_id long, place int, positive_score long, pos int, anchor_id long")
        pairs = _merged(_best_rows(rows, sent, negatives, held), negatives).join(F.broadcast(positive.drop("place")), ["no", "pos"])
        pairs.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        held.destroy()
        sent.destroy()
    return spark.read.schema(RESULT).parquet(path)


def _groups(blocks: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Blocks of up to ``limit`` bytes together; the driver holds one group."""
    group, held = [], 0
    for b in blocks.toLocalIterator():
        if group and held + len(b.vectors) > limit:
            yield group
            group, held = [], 0
        group.append((list(b.ids), list(b.labels), bytes(b.vectors), b.width))
        held += len(b.vectors)
    if group:
        yield group


def _anchor_ids(group: list[tuple]) -> list[int]:
    return list(itertools.chain.from_iterable(b[0] for b in group))


def _positives(group: list[tuple], near: list[dict], k: int) -> Iterator[tuple[int, int, int, int]]:
    """no, place, score, id of each anchor's positives: its best rows without one that equals itself in id and score."""
    ids = _anchor_ids(group)
    own = [_saturated(int(x)) for b in group for x in _self_scores(np.frombuffer(b[2]).reshape(len(b[0]), b[3]))]
    for no, rows in itertools.groupby(near, key=lambda r: r["no"]):
        rows = [(r["score"], r["vec_id"]) for r in rows]
        if (own[no], ids[no]) in rows:
            rows.remove((own[no], ids[no]))
        for place, (score, i) in enumerate(rows[:k]):
            yield no, place, score, i


def _self_scores(matrix: np.ndarray) -> list[int]:
    return [int(products(row[None, :], row[None, :])[0, 0]) if len(row) else 0 for row in matrix]
