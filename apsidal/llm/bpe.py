"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become class codes by one table lookup. Where a token may start depends on what was
consumed before, so each class code stands for a transition function of a small automaton; functions
compose associatively, and a blocked scan of the compositions gives the state before every code point
with array operations only. Class changes and those states mark the boundaries of the public pattern
without a regular expression. The resulting slices are looked up in a bounded cache; a miss merges
pairs by rank. Token ends (byte offsets) are kept, so any span can be decoded on its own.

Scale: a narrow map without shuffle; each task holds one slab of texts (``slab_chars`` code points,
or a single longer text). The rank file reaches executors as a broadcast of fixed size.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code point classes.
END, LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, SHORT = range(8)
#: Unicode white space, as the pattern's \s reads it.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings after an apostrophe that are tokens of their own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: States after a code point: a quote continues the token / starts a new one / an ending has begun.
HELD, FREE, ENDING = range(3)
#: Transition function of each class code, as the images of HELD, FREE and ENDING.
MOVES = {
    END: (FREE, FREE, FREE),
    LETTER: (FREE, FREE, FREE),
    NUMBER: (FREE, FREE, FREE),
    OTHER: (HELD, HELD, HELD),
    BLANK: (FREE, FREE, FREE),
    SPACE: (HELD, HELD, HELD),
    QUOTE: (HELD, HELD, HELD),
    SHORT: (HELD, ENDING, HELD),
}
STATES = 3
#: Rank of a pair that is no token.
NO_RANK = 1 << 62


def _kept(name: str, make):
    """An object that stays in a Python worker between tasks."""
    store = sys.modules.setdefault("_apsidal_kept", types.ModuleType("_apsidal_kept"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    letters = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        kind = letters.get(unicodedata.category(chr(cp))[0])
        if kind:
            table[cp] = kind
    table[WHITE] = BLANK
    table[0x20] = SPACE
    table[0x27] = QUOTE
    return table


def _make_algebra() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's function, table of compositions (first f, then g), and images."""
    images = np.array([[(k // STATES**s) % STATES for s in range(STATES)] for k in range(STATES**STATES)], np.uint8)
    number = lambda im: int(sum(int(v) * STATES**s for s, v in enumerate(im)))
    of_class = np.array([number(MOVES[c]) for c in range(len(MOVES))], np.uint8)
    compose = np.array([[number(g[f]) for g in images] for f in images], np.uint8)
    return of_class, compose, images


def _algebra() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _kept("algebra", _make_algebra)


def scan_functions(f: np.ndarray, compose: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of a sequence of function numbers: blocks side by side, then their totals."""
    n = len(f)
    if n <= block:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i]]
        return out
    identity = np.uint8(sum(s * STATES**s for s in range(STATES)))
    rows = -(-n // block)
    grid = np.full(rows * block, identity, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for i in range(1, block):
        grid[i] = compose[grid[i - 1], grid[i]]
    before = np.concatenate(([identity], scan_functions(grid[-1], compose, block)[:-1]))
    return np.ascontiguousarray(compose[before[None, :], grid].T).reshape(-1)[:n]


def token_starts(cps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions where a slice of the pattern starts. Texts are divided by END marks (code 0xFFFFFFFF)."""
    n = len(cps)
    end = cps == 0xFFFFFFFF
    cls = table[np.where(end, 0, cps)]
    cls[end] = END
    quotes = np.flatnonzero(cls == QUOTE)
    length = np.zeros(len(quotes), np.int64)
    for word in ENDINGS:
        hit = quotes + len(word) < n
        for k, c in enumerate(word):
            hit[hit] = cps[quotes[hit] + 1 + k] == ord(c)
        length[hit & (length == 0)] = 1 + len(word)
    code = cls.copy()
    code[quotes[length > 0]] = SHORT
    of_class, compose, images = _algebra()
    after = images[scan_functions(of_class[code], compose), FREE]
    shorts = quotes[(length > 0)]
    taken = after[shorts] == ENDING
    shorts, length = shorts[taken], length[length > 0][taken]

    group = np.array([END, LETTER, NUMBER, OTHER, BLANK, BLANK, OTHER, OTHER], np.uint8)[cls]
    white = group == BLANK
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = group[1:] != group[:-1]
    last = np.zeros(n, bool)  # last of a run of white space, something else follows in the text
    last[:-1] = white[:-1] & ~white[1:] & (group[1:] != END)
    start = change | last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (cls[:-1] == SPACE)  # the space belongs to what follows
    start &= ~joined
    start[shorts + 1] = False
    ends = shorts + length
    start[ends[ends < n]] = True
    return np.flatnonzero(start & (group != END))


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one slice: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    get = ranks.get
    if n <= 96:
        cut = list(range(n + 1))
        pairs = [get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
        while pairs and (best := min(pairs)) != NO_RANK:
            i = pairs.index(best)
            del cut[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[cut[i] : cut[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], NO_RANK)
        return tuple([ranks[piece[x:y]] for x, y in zip(cut, cut[1:], strict=False)])
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid] = False
        end[i] = stop
        after[i] = after[mid]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class PieceCache(dict):
    """Slices already merged; emptied when full, so its memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000) -> None:
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = merge_piece(piece, self.ranks)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, content: bytes) -> None:
        ranks = load_ranks(content)
        self.cache = PieceCache(ranks)
        self.table = class_table()
        self.vocab = {i: b for b, i in ranks.items()}
        self.width = np.zeros(max(self.vocab, default=-1) + 1, np.int32)
        for i, b in self.vocab.items():
            self.width[i] = len(b)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and token ends (byte offsets) of each text."""
        mark = b"\xff\xff\xff\xff"
        raw = [t.encode("utf-32-le") for t in texts]
        cps = np.frombuffer(mark.join(raw) + mark, np.uint32)
        size = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        first = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
        starts = token_starts(cps, self.table)
        width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
        width[cps == 0xFFFFFFFF] = 0
        at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        flat = "".join(texts).encode()
        cut = np.searchsorted(starts, np.append(first, len(cps)))
        begin = at[starts].tolist()
        pieces = [flat[a:b] for a, b in zip(begin, [*begin[1:], len(flat)], strict=False)]
        found = list(map(self.cache.__getitem__, pieces))
        counts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts[-1]))
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = ids[counts[a] : counts[b]]
            out.append((own, np.cumsum(self.width[own], dtype=np.int32)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


def _codec(content: bytes) -> Codec:
    import hashlib

    return _kept("codec_" + hashlib.sha256(content).hexdigest(), lambda: Codec(content))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), kind))


def bpe_encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", slab_chars: int = 1 << 20) -> DataFrame:
    """doc_id, ids array<int>, ends array<int>: tokens of every whole text and the byte where each ends.

    Null text counts as empty and gives empty arrays. Each row is encoded on its own; repeated rows,
    null ids and extra columns need no care. ``rank_file`` holds a base64 token and its rank per line.
    """
    with open(rank_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)

        def out(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            done = codec.encode(texts)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), _lists([i for i, _ in done], pa.int32()), _lists([e for _, e in done], pa.int32())], names=["doc_id", "ids", "ends"])

        for batch in batches:
            doc_ids, texts, chars = [], [], 0
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(d.as_py())
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= slab_chars:
                    yield out(doc_ids, texts)
                    doc_ids, texts, chars = [], [], 0
            if texts:
                yield out(doc_ids, texts)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, ends array<int>")


def bpe_decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_le (ids as little-endian unsigned 32-bit integers), decoded (bytes) from doc_id, ids."""
    with open(rank_file, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                flat, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                own = [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()), pa.array([codec.decode(x) for x in own], pa.binary())],
                    names=["doc_id", "n_tokens", "ids_le", "decoded"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_le binary, decoded binary")


def decode_span(ids: np.ndarray, ends: np.ndarray, start: int, stop: int, vocab: dict[int, bytes]) -> bytes:
    """Bytes [start, stop) of a text from its tokens, touching only the tokens that cover the span."""
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    base = int(ends[a - 1]) if a else 0
    return b"".join(vocab[int(i)] for i in ids[a:b])[start - base : stop - base]
