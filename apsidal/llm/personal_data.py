"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers they do not match.

The base patterns find mail addresses, network addresses, card and phone numbers. These seeds induce
lexical patterns: the two words before, the word on either side, or a label such as ``phone:`` before.
Other digit-bearing runs are candidates. Patterns and instances form a bipartite graph that Spark scores in
rounds: a pattern is trusted for a kind where enough different known instances of the kind stand in it and
few others; an instance becomes known where it has the format of the kind and most of its occurrences
stand in trusted patterns. Rounds go on until nothing changes. All occurrences of what became known are
reported beside the base spans.

Scale: one narrow map over whole texts writes spans and hashed contexts, which are few and small, to the
shared folder. Edges are pre-aggregated before each shuffle, patterns with too few instances go first,
and hot instances or patterns meet their one row by broadcast (``looked_up``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, looked_up, sized_broadcast, stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans in the order of the result; found ones come from contexts.
ALL_KINDS = (*KINDS, *(f"found_{k}" for k in KINDS))
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]+")
#: Runs that may be an identifier, grown from a digit or an @; groups of digits may be one space apart.
ANCHOR = re.compile(r"[0-9@]")
RUN = re.compile(r"[A-Za-z0-9@._%+()/#-]*")
IN_RUN = LOCAL | set("@()/#")
NEXT_GROUP = re.compile(r"\x20(?=[()+.-]*+[0-9])[0-9()+.-]++(?![A-Za-z@_%/#])")
GROUPS = re.compile(r"[0-9()+.-]+")
EDGE = "._%/#-"
WORD_EDGE = "\"'`.,;!?<>()[]{}*&$%|"
#: Characters of a context word that count, those nearest to the span.
WORD_CHARS = 64
#: Different known instances that a pattern needs, and its least score; an unknown instance weighs half of one that is not of the kind.
MIN_SUPPORT, MIN_SCORE, UNKNOWN = 3, 0.7, 0.5
#: Least share of an instance's occurrences in trusted patterns.
MIN_SHARE = 0.5


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the name before it, back to the last match, and the domain after it: linear for any text."""
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            low = m.end()
            yield start, low
        at = text.find("@", at + 1)


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def fitting(value: str) -> int:
    """Bits of the kinds whose format a value has, looser than the base patterns."""
    n, letters = len(digits_of(value)), sum(c.isalpha() for c in value)
    if "@" in value:
        return 1 << 0 if 0 < value.find("@") < len(value) - 1 else 0
    out = 1 << 1 if not letters and re.fullmatch(r"[0-9]+(\.[0-9]+){2,}", value) else 0
    out |= 1 << 2 if letters <= 2 and 12 <= n <= 19 and "." not in value else 0
    return out | (1 << 3 if not letters and 7 <= n <= 15 else 0)


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Digit-bearing runs outside the taken spans (ascending), without punctuation at their edges."""
    at = k = 0
    while m := ANCHOR.search(text, at):
        a, b = m.start(), RUN.match(text, m.start()).end()
        while a > at and text[a - 1] in IN_RUN:
            a -= 1
        if GROUPS.fullmatch(text, a, b):
            while more := NEXT_GROUP.match(text, b):
                b = more.end()
        at = b
        while a < b and text[a] in EDGE:
            a += 1
        more = text.count("(", a, b) - text.count(")", a, b)  # brackets without a partner go with the edge
        while a < b and (text[b - 1] in EDGE or (more and text[b - 1] in "()")):
            b -= 1
            more -= (text[b] == "(") - (text[b] == ")")
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        free = k == len(taken) or taken[k][0] >= b
        if free and b - a >= 4 and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
            yield a, b


def word_before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before a place, on the same line, and where it starts; ^ at the line's beginning."""
    b = at
    while b and text[b - 1] in " \t\r\x0b\x0c":
        b -= 1
    if not b or text[b - 1] == "\n":
        return "^", b
    a, least = b, max(0, b - WORD_CHARS)
    while a > least and text[a - 1] in ":=#":
        a -= 1
    while a > least and not text[a - 1].isspace() and text[a - 1] not in ":=":
        a -= 1
    return plain_word(text[a:b]), a


AFTER = re.compile(rf"[^\S\n]*([^\s:=]{{0,{WORD_CHARS}}}[:=]?)")


def word_after(text: str, at: int) -> str:
    m = AFTER.match(text, at)
    return plain_word(m[1]) if m[1] else "$"


def plain_word(word: str) -> str:
    """Lower case, digits as 0, no punctuation around; a label keeps its mark."""
    mark = word[-1] if word[-1] in ":=#" else ""
    return DIGITS.sub("0", word.rstrip(":=#").strip(WORD_EDGE).lower()) + mark


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span; each holds a letter, or it would say nothing."""
    one, at = word_before(text, start)
    two, _ = word_before(text, at)
    after = word_after(text, end)
    out = [f"before\0{two}\0{one}", f"around\0{one}\0{after}"]
    if one[-1:] in (":", "=", "#"):
        out.append(f"label\0{one}")
    return [p for p in out if any(c.isalpha() for c in p.partition("\0")[2])]


SEEN = [("start", pa.int64()), ("end", pa.int64()), ("seed", pa.int32()), ("fits", pa.int32()), ("inst", pa.binary()), ("pats", pa.list_(pa.binary()))]
SEEN_SQL = "array<struct<start: long, end: long, seed: int, fits: int, inst: binary, pats: array<binary>>>"
SPANS_SQL = "array<struct<kind: int, start: long, end: long>>"


def scan_text(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and all seeds and candidates with hashes (128 bits) of their value and their patterns."""
    import xxhash

    base = base_spans(text)
    merged: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    own = [(a, b, 1 << k) for k, a, b in base] + [(a, b, 0) for a, b in candidates(text, merged)]
    seen = []
    for a, b, seed in own:
        fits = seed or fitting(text[a:b])
        seen.append({"start": a, "end": b, "seed": seed, "fits": fits, "inst": xxhash.xxh128_digest(text[a:b].lower().encode()), "pats": [xxhash.xxh128_digest(p.encode()) for p in contexts(text, a, b)]})
    return [{"kind": k, "start": a, "end": b} for k, a, b in base], seen


def scan_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base, seen: written once to the shared folder."""
    base_kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py() or "") for t in batch.column(2)]
            cols = [batch.column(0), batch.column(1), pa.array([b for b, _ in found], base_kind), pa.array([s for _, s in found], pa.list_(pa.struct(SEEN)))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "base", "seen"])

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(src.mapInArrow(run, f"row long, doc_id long, base {SPANS_SQL}, seen {SEEN_SQL}"))


def _bit(kinds: Column | str, k: int) -> Column:
    return (kinds if isinstance(kinds, Column) else F.col(kinds)).bitwiseAND(1 << k) > 0


def _mask(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for k, c in enumerate(conditions):
        out = out + F.when(c, 1 << k).otherwise(0)
    return out


def pattern_graph(scanned: DataFrame, min_support: int = MIN_SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (pat, inst, n: different instances of the pattern), contexts (pat, inst, place, times) and instances (inst, total, fits, seed).

    A place stands for all occurrences of an instance in the same patterns. Patterns with too few instances
    can never be trusted and are left out.
    """
    seen = scanned.select(F.inline("seen"))
    places = seen.groupBy("inst", "pats").agg(F.count(F.lit(1)).alias("times"), F.bit_or("fits").alias("fits"), F.bit_or("seed").alias("seed"))
    places = checkpoint(places.withColumn("place", F.xxhash64("inst", "pats")))
    contexts = places.select("inst", "place", "times", F.explode("pats").alias("pat"))
    pairs = contexts.select("pat", "inst").distinct()
    counts = pairs.groupBy("pat").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
    edges = checkpoint(looked_up(pairs, checkpoint(counts), "pat"))
    contexts = checkpoint(looked_up(contexts, edges.select("pat").distinct(), "pat"))
    instances = places.groupBy("inst").agg(F.sum("times").alias("total"), F.bit_or("fits").alias("fits"), F.bit_or("seed").alias("seed"))
    # of what is not known yet, only instances in such patterns can become known
    linked = edges.select("inst").distinct().withColumn("linked", F.lit(True))
    instances = instances.join(linked, "inst", "left").where((F.col("seed") > 0) | F.col("linked")).drop("linked")
    return edges, contexts, checkpoint(instances)


def trusted_patterns(edges: DataFrame, known: DataFrame, min_support: int, min_score: float) -> DataFrame:
    """pat, trusted (bits of kinds): patterns with enough known instances of a kind, and few known to be none or unknown."""
    met = looked_up(edges, known, "inst")
    sums = met.groupBy("pat", "n").agg(
        *[F.sum(_bit("kinds", k).cast("int")).alias(f"yes{k}") for k in range(len(KINDS))],
        *[F.sum(((F.col("kinds") > 0) & ~_bit("kinds", k)).cast("int")).alias(f"no{k}") for k in range(len(KINDS))],
    )
    good = [
        (F.col(f"yes{k}") >= min_support) & (F.col(f"yes{k}") >= min_score * (F.col(f"yes{k}") + F.col(f"no{k}") + UNKNOWN * (F.col("n") - F.col(f"yes{k}") - F.col(f"no{k}"))))
        for k in range(len(KINDS))
    ]
    return sums.select("pat", _mask(good).alias("trusted")).where("trusted > 0")


def known_instances(edges: DataFrame, contexts: DataFrame, instances: DataFrame, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE, min_share: float = MIN_SHARE) -> DataFrame:
    """inst, kinds (bits): seeds and what trusted patterns add to them, round after round until nothing is new."""
    known = checkpoint(instances.where("seed > 0").select("inst", F.col("seed").alias("kinds")))
    if edges.isEmpty():
        return known
    total = lambda df: df.agg(F.sum(F.bit_count("kinds"))).first()[0] or 0
    before, now = -1, total(known)
    while now > before:
        patterns = checkpoint(trusted_patterns(edges, known, min_support, min_score))
        inside = looked_up(contexts, patterns, "pat").groupBy("inst", "place").agg(F.first("times").alias("times"), F.bit_or("trusted").alias("trusted"))
        inside = inside.groupBy("inst").agg(*[F.sum(F.when(_bit("trusted", k), F.col("times")).otherwise(0)).alias(f"in{k}") for k in range(len(KINDS))])
        fresh = instances.join(inside, "inst").select("inst", _mask([_bit("fits", k) & (F.col(f"in{k}") > 0) & (F.col(f"in{k}") >= min_share * F.col("total")) for k in range(len(KINDS))]).alias("kinds"))
        known = checkpoint(known.unionByName(fresh.where("kinds > 0")).groupBy("inst").agg(F.bit_or("kinds").alias("kinds")))
        before, now = now, total(known)
    return known


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, spans array of (kind, start, end) by kind, then start; code points, end exclusive: one row per document.

    Base kinds come from the patterns alone, ``found_`` kinds from trusted contexts; a found span never
    overlaps a base span. Null and empty texts have no spans. Repeated rows have the same spans each, and
    their contexts count as one instance, so copies lend a pattern no support. Null ids and extra columns
    need no care, texts of any length are read whole, and an empty table gives an empty result.
    """
    scanned = scan_table(docs, id_col, text_col)
    edges, contexts, instances = pattern_graph(scanned, min_support)
    known = known_instances(edges, contexts, instances, min_support, min_score, min_share)
    new = checkpoint(known.join(instances.where("seed = 0").select("inst"), "inst", "left_semi"))
    hits = looked_up(scanned.select("row", F.inline("seen")).where("seed = 0").select("row", "start", "end", "inst"), new, "inst")
    kind = F.coalesce(*[F.when(_bit("kinds", k), len(KINDS) + k) for k in range(len(KINDS))])
    found = checkpoint(hits.groupBy("row").agg(F.collect_list(F.struct(kind.cast("int").alias("kind"), "start", "end")).alias("found")))
    # documents stay where they are as long as those with found spans are few
    met = scanned.select("row", "doc_id", "base").join(sized_broadcast(found, found.count()), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("found", F.from_json(F.lit("[]"), SPANS_SQL))))
    names = F.array(*map(F.lit, ALL_KINDS))
    return met.select("doc_id", F.transform(spans, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
