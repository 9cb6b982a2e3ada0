"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and which tokens meet there.

Both tokenizers code the same bytes, so cumulative sums of token lengths are comparable offsets. Offsets
that both share cut a text into groups; a group label is a binary search among these cuts, and the links
(pairs of tokens with overlapping bytes) come from two binary searches a token and one repeat-based
expansion. Texts end at a shared cut, so a whole slab of texts is aligned by one pass of array operations.

Scale: texts are encoded once, in a narrow map, and their packed ids are written to the shared folder,
with each task's sums of linked id pairs. The sums are shuffled in two stages, first with a salt. The most frequent pairs
(``BROADCAST_PAIRS`` at most) go to all tasks; what a text links beyond them is joined by key, where no
key is frequent any more. Long texts are encoded in pieces that both tokenizers cut anyway.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _kept
from .common import stored

#: Code points that are encoded together.
SLAB_CHARS = 1 << 16
#: Tokens whose links are made together.
SLAB_TOKENS = 1 << 16
#: Distinct pairs that a task holds before it hands them on.
TASK_PAIRS = 1 << 19
#: Most frequent pairs that are broadcast, two longs each.
BROADCAST_PAIRS = 1 << 20
SALTS = 16
#: A single space between two other characters starts a token in both tokenizers, whatever is around.
SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Pieces whose ids a task remembers, and their longest length; all are forgotten when full.
KNOWN_PIECES, PIECE_CHARS = 1 << 18, 48
#: An id pair as one long.
SHIFT = 32


def byte_table() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Pair:
    """Both tokenizers, from the contents of their files, and the bytes of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        self.bytes_a, self.bytes_b = vocabulary_a(self.a), vocabulary_b(self.b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.seams = not any("▁" in n.lstrip("▁") for n in names)
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.width_a, self.width_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.kind_a, self.kind_b = ("<u2" if len(v) <= 1 << 16 else "<u4" for v in (self.bytes_a, self.bytes_b))
        self.names = marked_names(len(self.bytes_a), len(self.bytes_b))

    def pieces(self, text: str) -> list[str]:
        """The text in parts that are encoded on their own; all but the first lack the space before them."""
        return SEAM.split(text) if self.seams else [text]

    def learn(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of space + piece by both (as 32-bit numbers), and whether both give its bytes back.

        Pieces without white space at their edges are encoded side by side, one space apart, as the
        tokenizers cut them there; where such a row does not come back byte by byte, and for all other
        pieces, each is encoded alone.
        """
        out: dict[str, tuple[bytes, bytes, bool]] = {}
        alone = [p for p in pieces if not self.seams or not p or p != p.strip()]
        rows: list[list[str]] = [[]]
        held = 0
        for p in pieces:
            if self.seams and p and p == p.strip():
                rows[-1].append(p)
                held += len(p) + 1
                if held >= SLAB_CHARS:
                    rows.append([])
                    held = 0
        for row in rows:
            parts = self.split(row)
            if parts is None:
                alone += row
            else:
                out.update(zip(row, parts, strict=True))
        for p in alone:
            ids = self.both(p)
            out[p] = (*(np.array(x, np.int32).tobytes() for x in ids), all(self.joined(k, x) == (" " + p).encode() for k, x in enumerate(ids)))
        return out

    def both(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)

    def split(self, row: list[str]) -> list[tuple[bytes, bytes, bool]] | None:
        """Ids of each piece out of those of all together; None where these do not give the bytes back."""
        if not row:
            return []
        text, sides = " ".join(row), []
        ends = np.cumsum([len(p.encode()) + 1 for p in row])
        for k, ids in enumerate(self.both(text)):
            if self.joined(k, ids) != (" " + text).encode():
                return None
            own = np.array(ids, np.int32)
            upto = np.cumsum((self.width_a, self.width_b)[k][own])
            cut = np.searchsorted(upto, ends)
            if (upto[cut] != ends).any():
                return None
            cut = np.concatenate(([0], cut + 1)) * 4
            raw = own.tobytes()
            sides.append([raw[i:j] for i, j in zip(cut, cut[1:], strict=False)])
        return [(x, y, True) for x, y in zip(*sides, strict=True)]

    def joined(self, side: int, ids: Iterable[int]) -> bytes:
        return b"".join(map((self.bytes_a, self.bytes_b)[side].__getitem__, ids))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of space + text by both; nothing where either does not give these bytes back."""
        parts = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        if len(known) > KNOWN_PIECES:
            known.clear()
        short = self.learn(list({p for ps in parts for p in ps if p not in known}))
        known.update((p, done) for p, done in short.items() if len(p) <= PIECE_CHARS)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.int32)
        for text, ps in zip(texts, parts, strict=True):
            found = [known.get(p) or short[p] for p in ps]
            a, b = (np.frombuffer(b"".join([f[side] for f in found]), np.int32) for side in (0, 1))
            whole = bool(ps) and (all([f[2] for f in found]) or self.joined(0, a.tolist()) == self.joined(1, b.tolist()) == (" " + text).encode())
            out.append((a, b) if whole else (none, none))
        return out


def vocabulary_a(tokenizer) -> list[bytes]:
    """Bytes of each token of a byte-level tokenizer; a token that is no byte-level string stands for its UTF-8."""
    table = byte_table()
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def vocabulary_b(processor) -> list[bytes]:
    """Bytes of each piece: byte pieces one byte, others their UTF-8 with a space for U+2581."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:-1], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets where tokens of both end, and the group of each token."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in A and in B of all linked occurrences, ordered by A, and how many links each token of A has."""
    starts = np.append(0, ends_a)[: len(ends_a)]
    first = np.searchsorted(ends_b, starts, "right")
    count = np.searchsorted(ends_b, ends_a, "left") - first + 1
    a = np.repeat(np.arange(len(ends_a)), count)
    b = np.arange(len(a)) + np.repeat(first - (np.cumsum(count) - count), count)
    return a, b, count


def marked_names(names_a: int, names_b: int) -> tuple[list[str], np.ndarray]:
    """Decimal ids of A, then of B, each followed by the mark , or | or ; and where each of the six parts begins."""
    sizes = [names_a] * 3 + [names_b] * 3
    return [f"{i}{mark}" for n in (names_a, names_b) for mark in ",|;" for i in range(n)], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, names: tuple[list[str], np.ndarray]) -> list[str]:
    """Ids of A, then of B, of one group after another, each with the mark that follows it."""
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    side = np.repeat(np.array([0, 1]), (len(ids_a), len(ids_b)))[order]
    group = np.concatenate((group_a, group_b))[order]
    mark = np.full(len(order), 2)
    mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
    at = names[1][3 * side + mark] + np.concatenate((ids_a, ids_b))[order]
    return list(map(names[0].__getitem__, at.tolist()))


class Slab:
    """The tokens of several texts, one after another, aligned together: every text ends at a shared cut."""

    def __init__(self, pair: Pair, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> None:
        (self.a, self.from_a), (self.b, self.from_b) = a, b
        self.ends_a, self.ends_b = np.cumsum(pair.width_a[self.a]), np.cumsum(pair.width_b[self.b])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The id pair of each link as one long, and where each text's links begin and end."""
        a, b, count = links(self.ends_a, self.ends_b)
        upto = np.concatenate(([0], np.cumsum(count)))
        return self.a[a] << SHIFT | self.b[b], upto[self.from_a]


def _joined(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists as one array, and where each list begins and ends in it."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return np.concatenate(lists).astype(np.int64), bounds


def _packed(values: np.ndarray, bounds: np.ndarray, kind: str) -> pa.Array:
    """Lists of ids as binaries of little-endian unsigned numbers."""
    raw, size = values.astype(kind), np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind).astype(np.int64), (bounds - bounds[0]) // np.dtype(kind).itemsize


def _slabs(batches: Iterator[pa.RecordBatch], pair: Pair) -> Iterator[tuple[pa.RecordBatch, Slab]]:
    """Parts of batches of up to ``SLAB_TOKENS`` tokens, or of one text; columns a and b hold the ids."""
    for batch in batches:
        at, column = 0, batch.schema.get_field_index("a")
        upto = _unpacked(batch.column(column), pair.kind_a)[1]
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLAB_TOKENS, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, Slab(pair, _unpacked(part.column(column), pair.kind_a), _unpacked(part.column(column + 1), pair.kind_b))
            at = to


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


class PairSums:
    """Links of id pairs, summed up in a task; memory is bounded by ``TASK_PAIRS``."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to hand on what is summed."""
        self.held.append(keys)
        if sum(map(len, self.held)) >= TASK_PAIRS:
            self.sum()
        return len(self.keys) >= TASK_PAIRS

    def sum(self) -> None:
        if self.held:
            new, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.held = []
            every, at = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, at, np.concatenate((self.counts, n)))
            self.keys, self.counts = every, total

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.sum()
        out = self.keys, self.counts
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
CODED_SQL = "row long, doc_id long, a binary, b binary, n_groups long, groups_sha256 string, key long, n long"


def encode_both(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, a, b (packed ids), n_groups, groups_sha256 of every row; and, in rows of their own, key and n.

    The second kind holds each task's counts of linked id pairs. Both are written once to the shared folder.
    Null and empty texts, and those that one of the tokenizers does not give back byte by byte, have no tokens.
    """
    sc = docs.sparkSession.sparkContext
    files = sc.broadcast(tuple(_content(f) for f in (byte_file, piece_file)))

    def padded(cols: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in CODED], schema=CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sums = _pair(files.value), PairSums()

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = sums.take()
            for at in range(0, len(keys), SLAB_TOKENS):
                part = keys[at : at + SLAB_TOKENS]
                yield padded({"key": pa.array(part), "n": pa.array(n[at : at + SLAB_TOKENS])}, len(part))

        def coded(rows: list[tuple[int, int | None]], texts: list[str]) -> Iterator[pa.RecordBatch]:
            ids = pair.encode(texts)
            a, b = _joined([x for x, _ in ids]), _joined([x for _, x in ids])
            slab = Slab(pair, a, b)
            cuts, group_a, group_b = common_cuts(slab.ends_a, slab.ends_b)
            marked = group_texts(slab.a, slab.b, group_a, group_b, pair.names)
            both = slab.from_a + slab.from_b
            groups = ["".join(marked[i:j])[:-1] for i, j in zip(both, both[1:], strict=False)]
            ends = np.concatenate(([0], slab.ends_a))[slab.from_a]
            n_groups = np.diff(np.searchsorted(cuts, ends, "right"))
            cols = {"row": pa.array([r for r, _ in rows], pa.int64()), "doc_id": pa.array([d for _, d in rows], pa.int64()), "a": _packed(*a, pair.kind_a), "b": _packed(*b, pair.kind_b)}
            cols |= {"n_groups": pa.array(n_groups, pa.int64()), "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())}
            yield padded(cols, len(rows))
            if sums.add(slab.links()[0]):
                yield from counted()

        for batch in batches:
            rows, texts, held = [], [], 0
            for r, d, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                rows.append((r.as_py(), d.as_py()))
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= SLAB_CHARS:
                    yield from coded(rows, texts)
                    rows, texts, held = [], [], 0
            if rows:
                yield from coded(rows, texts)
        yield from counted()

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(src.mapInArrow(run, CODED_SQL))


def pair_counts(coded: DataFrame) -> DataFrame:
    """key (an id pair), n: how many links of the corpus hold the pair; tasks' sums are added up in two shuffles."""
    sums = coded.where(F.col("key").isNotNull()).select("key", "n")
    salted = sums.groupBy("key", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    return stored(salted.groupBy("key").agg(F.sum("n").alias("n")))


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte (such as those
    with U+2581), have no tokens: zeros and an empty digest. Rows are independent, so repeated rows count
    each, and null ids and extra columns need no care. Texts of any length are encoded whole, in pieces. An
    empty table gives an empty result. ``broadcast_pairs`` bounds what is broadcast; the result is the same
    for any value.
    """
    spark = docs.sparkSession
    coded = encode_both(docs, byte_file, piece_file, id_col, text_col)
    files = spark.sparkContext.broadcast(tuple(_content(f) for f in (byte_file, piece_file)))
    counts = pair_counts(coded)
    b_id = F.col("key").bitwiseAND((1 << SHIFT) - 1).alias("b")
    best = counts.groupBy(b_id).agg(F.max("n").alias("most")).toArrow()  # one row per id of B at most
    top = counts.orderBy(F.desc("n"), "key").limit(broadcast_pairs).toArrow()
    order = np.argsort(top.column("key").to_numpy(), kind="stable")
    sent = spark.sparkContext.broadcast((top.column("key").to_numpy()[order], top.column("n").to_numpy()[order], best.column("b").to_numpy(), best.column("most").to_numpy()))
    missing_kind = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files.value)
        keys, n, ids, most = sent.value
        best_of = np.zeros(len(pair.width_b), np.int64)
        best_of[ids] = most
        for part, slab in _slabs(batches, pair):
            own, bounds = slab.links()
            every, at = np.unique(own, return_inverse=True)
            place = np.minimum(np.searchsorted(keys, every), max(len(keys) - 1, 0))
            known = keys[place] == every if len(keys) else np.zeros(len(every), bool)
            count = np.where(known, n[place], 0) if len(keys) else np.zeros(len(every), np.int64)
            is_best = known & (count == best_of[every & ((1 << SHIFT) - 1)])
            if known.all():
                missing = [[]] * part.num_rows
            else:
                rest = [at[i:j][~known[at[i:j]]] for i, j in zip(bounds, bounds[1:], strict=False)]
                missing = [[{"key": int(every[k]), "times": int(c)} for k, c in zip(*np.unique(r, return_counts=True), strict=True)] for r in rest]
            longs = [np.diff(slab.from_a), np.diff(slab.from_b), np.diff(bounds), _per_text(is_best[at], bounds), _per_text(count[at], bounds)]
            cols = [part.column(0), part.column(1), *(pa.array(x.astype(np.int64)) for x in longs), part.column(4), part.column(5), pa.array(missing, missing_kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_a", "n_b", "n_links", "n_best", "count_sum", "n_groups", "groups_sha256", "missing"])

    kind = "row long, doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, n_groups long, groups_sha256 string, missing array<struct<key: long, times: long>>"
    rows = coded.where(F.col("row").isNotNull()).select("row", "doc_id", "a", "b", "n_groups", "groups_sha256").mapInArrow(run, kind)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if top.num_rows < broadcast_pairs:
        return rows.select(columns)
    rows = stored(rows)
    highest = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    tail = rows.select("row", F.inline("missing")).join(counts, "key").join(highest, b_id == F.col("b"))
    sums = tail.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    met = rows.drop("missing").join(sums, "row", "left")
    return met.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(columns)


def _content(file: str) -> bytes:
    with open(file, "rb") as f:
        return f.read()


def _pair(files: tuple[bytes, bytes]) -> Pair:
    name = "pair_" + hashlib.sha256(files[0] + files[1]).hexdigest()
    return _kept(name, lambda: Pair(*files))
