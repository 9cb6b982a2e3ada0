"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most ``max_bits`` bits
share at least ``8 - max_bits`` of them, so they meet in the posting list of at least one byte
combination out of a small covering family (for two bits: six combinations of four positions). In a
posting list the shared positional bytes of each pair are tallied, pairs below the guaranteed minimum
are dropped, and the rest are verified bit by bit. Only a spanning forest of a list leaves the task.

Scale: identical fingerprints are merged first, with map-side combine, so thousands of copies are one
entry. The tally goes on the same way at every list size: a list of more than ``dense`` fingerprints is
split by further byte positions, as many as the guaranteed minimum still asks for, since a pair that
reaches the minimum shares them too. For two bits such a list is keyed by six bytes, so it holds at most
65 536 different fingerprints, whatever the input. No list is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, looked_up, sized_broadcast, with_group_aggs

BITS = 64
BYTES = BITS // 8


def simhash64(text: str | bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text; a bit is set if it is set in over half the shingle hashes."""
    import xxhash

    raw = text if isinstance(text, bytes) else (text or "").encode()
    tokens = raw.lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - shingle_words + 1)
    last = min(shingle_words, len(tokens)) - 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)), np.uint64, to - at)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, hashed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; null text counts as empty.

    With ``hashed`` also sha, the SHA-256 of the text as it is (empty for null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash64(t.as_py(), shingle_words) for t in b.column(1)), np.uint64, b.num_rows)
            shas = [pa.array(["" if t is None else hashlib.sha256(t).hexdigest() for t in b.column(1).to_pylist()], pa.string())] if hashed else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *shas], names=["doc_id", "fp", "sha"][: 2 + hashed])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long" + ", sha string" * hashed)


def covering(max_bits: int, width: int) -> list[tuple[int, ...]]:
    """Byte combinations of ``width`` positions such that any ``max_bits`` bad bytes miss one of them."""
    pool = list(combinations(range(BYTES), width))
    left = set(combinations(range(BYTES), max_bits))
    family = []
    while left:
        best = max(pool, key=lambda c: sum(not set(c) & set(x) for x in left))
        family.append(best)
        left = {x for x in left if set(best) & set(x)}
    return family


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of n items under the links a-b: min-label rounds with jumping."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    while (root[root] != root).any():
        root = root[root]
    return root


def list_links(fps: np.ndarray, max_bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smaller fingerprint) of the pairs within max_bits in one posting list.

    ``shared`` positional bytes agree by the list's key; where that is the guaranteed minimum already,
    every pair of the list reaches the count and is only verified.
    """
    fps = np.unique(fps)
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    byte = fps.view(np.uint8).reshape(n, BYTES)
    a, b = [], []
    for i in range(n - 1):
        near = np.arange(i + 1, n)
        if shared < BYTES - max_bits:
            near = near[(byte[i + 1 :] == byte[i]).sum(1) >= BYTES - max_bits]
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= max_bits]
        if len(near):
            a.append(np.full(len(near), i))
            b.append(near)
    if not a:
        return fps[:0], fps[:0]
    root = _roots(n, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def _posting_links(postings: DataFrame, max_bits: int, shared: int) -> DataFrame:
    """Links of all posting lists: one stream over sorted lists per task, a list at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out(lists: list[np.ndarray]) -> pa.RecordBatch:
            links = [list_links(x, max_bits, shared) for x in lists]
            a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.uint64)
            b = np.concatenate([x for _, x in links]) if links else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            slot, value, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero((slot[1:] != slot[:-1]) | (value[1:] != value[:-1])) + 1
            parts = np.split(fp, cuts)
            lists = []
            if key == (slot[0], value[0]):
                held.append(parts[0])
            else:
                if held:
                    lists.append(np.concatenate(held))
                held = [parts[0]]
            if len(parts) > 1:
                lists.append(np.concatenate(held))
                lists += [p for p in parts[1:-1] if len(p) > 1]
                held = [parts[-1]]
            key = (slot[-1], value[-1])
            yield out([x for x in lists if len(x) > 1])
        if held:
            yield out([np.concatenate(held)])

    dealt = postings.repartition("slot", "value").sortWithinPartitions("slot", "value")
    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, max_bits: int = 2, key_bytes: int = 4, dense: int = 1024) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints ``fp``: same components as all pairs within max_bits.

    Lists of more than ``dense`` fingerprints are split by the further bytes that the guaranteed minimum
    of ``8 - max_bits`` asks for; with ``key_bytes`` at that minimum there are none and lists stay whole.
    """
    combos, least = covering(max_bits, key_bytes), BYTES - max_bits
    if not combos or key_bytes > least:
        raise ValueError("no byte combination survives that many bad bytes; use fewer bits or narrower keys")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))

    def entry(c: tuple[int, ...]) -> Column:
        """The list of a combination: its positions as a bit mask, and their bytes."""
        v = F.lit(0).cast("long")
        for i in c:
            v = F.shiftleft(v, 8).bitwiseOR(byte(i))
        return F.struct(F.lit(sum(1 << i for i in c)).alias("slot"), v.alias("value"))

    entries = fps.select("fp", F.explode(F.array(*map(entry, combos))).alias("e")).select("e.slot", "e.value", "fp")
    if key_bytes == least:
        return _posting_links(entries, max_bits, key_bytes).distinct()
    big = checkpoint(entries.groupBy("slot", "value").count().where(F.col("count") > dense).select("slot", "value"))
    n_big = big.count()
    if not n_big:
        return _posting_links(entries, max_bits, key_bytes).distinct()
    long = sized_broadcast(big, n_big)
    links = _posting_links(entries.join(long, ["slot", "value"], "left_anti"), max_bits, key_bytes)
    finer = F.lit(None)
    for c in combos:
        rest = [i for i in range(BYTES) if i not in c]
        finer = F.when(F.col("slot") == sum(1 << i for i in c), F.array(*[entry(tuple(sorted(c + m))) for m in combinations(rest, least - key_bytes)])).otherwise(finer)
    split = entries.join(long, ["slot", "value"], "left_semi").select("fp", F.explode(finer).alias("e")).select("e.slot", "e.value", "fp").distinct()
    return links.unionByName(_posting_links(split, max_bits, least)).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of the connected components of links (a, b), by alternating large and small stars.

    Each round is a few shuffles over the links; hubs are grouped skew-safely. Nodes without links
    are not listed. root is the smallest node of its component.
    """

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    edges, before = checkpoint(turned(links)), None
    for _ in range(max_rounds):
        stamp = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if stamp == before or not stamp[0]:
            break
        before = stamp
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = with_group_aggs(both, ["a"], {"m": F.min("b")})
        large = checkpoint(turned(low.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).unionByName(low.where("b <= a").select("a", F.col("m").alias("b")))))
        low = with_group_aggs(large, ["a"], {"m": F.min("b")})
        edges = checkpoint(turned(low.select("a", F.col("m").alias("b")).unionByName(low.select(F.col("b").alias("a"), F.col("m").alias("b")))))
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def component_firsts(prints: DataFrame, first: Column, max_bits: int) -> DataFrame:
    """fp, low: for each fingerprint the smallest value of ``first`` among the rows of its component."""
    fps = checkpoint(prints.groupBy("fp").agg(F.min(first).alias("first")))
    comp = components(fingerprint_links(fps, max_bits))
    every = fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return checkpoint(with_group_aggs(every, ["root"], {"low": F.min("first")}).select("fp", "low"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Texts without words have fingerprint zero and link like any other. Null text counts as empty, a
    null id sorts last (a component of null ids only has component_id null), repeated rows stay.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle_words))
    low = component_firsts(prints, F.col("doc_id"), max_bits)
    return looked_up(prints, low, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """Exactly one row of each group of near copies, with all its columns.

    The smallest id stays, null ids sort last, and among rows of one id the smallest text hash. Rows
    are matched by id and text hash; of rows equal in both one stays.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle_words, hashed=True))
    low = component_firsts(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "sha"), max_bits)
    rows = looked_up(prints, low, "fp").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), (F.col("doc_id").eqNullSafe(F.col("low.id")) & (F.col("sha") == F.col("low.sha"))).alias("stays"))
    met = rows.groupBy("__id", "__sha").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    met = checkpoint(met.where("not stays or n > 1").select("__id", "__sha", "stays"))
    gone = sized_broadcast(met.select("__id", "__sha"), met.count())
    again = met.where("stays").select("__id", "__sha")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).cast("long").alias("__own"), F.coalesce(F.sha2(F.col(text_col).cast("string").cast("binary"), 256), F.lit("")).alias("__text"))
    same = lambda keys: F.col("__own").eqNullSafe(keys["__id"]) & (F.col("__text") == keys["__sha"])
    out = whole.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        out = out.unionByName(whole.join(again, same(again), "left_semi").dropDuplicates(["__own", "__text"]))
    return out.select("__doc.*")
