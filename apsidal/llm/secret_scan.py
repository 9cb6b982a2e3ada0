"""Secret scan: assignment-aware lexing of source and configuration text.

Around every assignment mark a lexer reads the name on its left and the expression on its right:
quoted or bare literals, names, and sums of them. Names bound to a literal are constants; a later use of
the name stands for that literal. Each literal is then scored by how sensitive the names are that it
reaches and how much it looks like a generated value; those above the threshold are reported where they
are written. Three base patterns are always reported as well.

Scale: a narrow map over whole texts, no shuffle. Cheap substring tests skip the patterns that cannot
match, so prose costs one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Assignment marks of source and configuration syntax.
MARK = re.compile(r"=>|:=|=|:")
LITERAL = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|((?:[^\s,;"'(){}\[\]<>&?]++|[&?](?![\w.-]+=))++)""")
PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Sensitivity of name parts; adjacent parts are looked up joined as well.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "clientsecret": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.9, "auth": 0.7, "signature": 0.6, "key": 0.5}
#: Values that stand for a secret without being one: of one such character throughout, equal to one of
#: the words, or beginning so (lower case).
PLACEHOLDER_CHARS = ("xX", "*", ".", "0")
PLACEHOLDER_WORDS = ("none", "null", "true", "false")
PLACEHOLDER_HEADS = ("1234", "example", "changeme", "change_me", "your", "test", "dummy", "todo", "${", "<", "%")
MIN_LITERAL = 8
THRESHOLD = 0.5
SPAN_SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    both = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in both), default=0.0)


class Value:
    """What scoring needs of a value: length, character counts, kinds of characters, its beginning.

    Values of sums are made of those of their terms without writing the text out. Characters beyond
    ASCII are counted in 128 classes, so a value is small however long it is; counts are scaled down
    together when they get large, as only their shares matter.
    """

    __slots__ = ("n", "counts", "kinds", "blank", "head")
    HEAD, LARGE = 16, 2.0**50

    def __init__(self) -> None:
        self.n, self.counts, self.kinds, self.blank, self.head = 0.0, {}, 0, False, ""

    @staticmethod
    def of(text: str) -> Value:
        out = Value()
        for c, k in Counter(text).items():
            out.count(c, k)
        out.head = text[: Value.HEAD]
        return out

    def count(self, c: str, k: float = 1) -> None:
        at = ord(c)
        at = at if at < 128 else 128 + at % 128
        self.counts[at] = self.counts.get(at, 0) + k
        self.n += k
        self.kinds |= 1 * c.islower() | 2 * c.isupper() | 4 * c.isdigit() | 8 * (not c.isalnum())
        self.blank = self.blank or c.isspace()

    def copy(self) -> Value:
        out = Value()
        out.n, out.counts, out.kinds, out.blank, out.head = self.n, dict(self.counts), self.kinds, self.blank, self.head
        return out

    def then(self, other: Value) -> Value:
        """Add the value that follows."""
        self.n += other.n
        for at, k in other.counts.items():
            self.counts[at] = self.counts.get(at, 0) + k
        self.kinds |= other.kinds
        self.blank = self.blank or other.blank
        self.head = (self.head + other.head)[: self.HEAD]
        if self.n > self.LARGE:
            self.n /= self.LARGE / 1024
            self.counts = {at: k / (self.LARGE / 1024) for at, k in self.counts.items()}
        return self

    def placeholder(self) -> bool:
        low = self.head.lower()
        if low.startswith(PLACEHOLDER_HEADS) or (self.n <= 5 and low in PLACEHOLDER_WORDS):
            return True
        return len(self.counts) <= 2 and any(all(chr(at) in chars for at in self.counts) for chars in PLACEHOLDER_CHARS)

    def strength(self) -> float:
        """How much the value looks like a generated one, from 0 to 1."""
        if self.n < MIN_LITERAL or self.blank or self.placeholder():
            return 0.0
        bits = -sum(k / self.n * math.log2(k / self.n) for k in self.counts.values())
        return min(1.0, bits / 3.5) * (0.55 + 0.15 * min(self.kinds.bit_count(), 3))


def strength(value: str) -> float:
    return Value.of(value).strength()


def suffix_values(text: str, starts: list[int], stop: int, rest: Value) -> list[Value]:
    """The values of text[a:stop] and the rest, for each start a (ascending), in one pass from the right."""
    run, out, at = rest.copy(), [], stop
    for a in reversed(starts):
        for c in text[a:at]:
            run.count(c)
        at = a
        one = run.copy()
        one.head = (text[a : min(stop, a + Value.HEAD)] + rest.head)[: Value.HEAD]
        out.append(one)
    return out[::-1]


class Node:
    """A literal (span) or a sum of nodes, with its value and the best score of a name it reaches."""

    __slots__ = ("span", "terms", "value", "score")

    def __init__(self, value: Value, span: tuple[int, int] | None = None, terms: tuple[Node, ...] = ()) -> None:
        self.value, self.span, self.terms, self.score = value, span, terms, 0.0


def sum_rest(text: str, at: int) -> list[tuple[int, int, bool]]:
    """(start, end, is a name) of the further terms of a sum; one with a mark inside is the last, its own pair goes on."""
    out = []
    while (more := PLUS.match(text, at)) and (m := LITERAL.match(text, more.end())):
        at = m.end()
        if m[3] is None:
            out.append((*m.span(1 if m[1] is not None else 2), False))
            continue
        bare = m[3].rstrip(".:!?")
        if bare:
            out.append((m.start(), m.start() + len(bare), bare.isidentifier()))
        if MARK.search(m[3]):
            break
    return out


def name_literal_pairs(text: str) -> Iterator[tuple[list[tuple[str, int]], int, bool, list[tuple[int, int, bool]]]]:
    """Assignments in order: (names with the starts of their literals, end of these literals, quoted, further terms).

    A bare literal ends at white space, brackets, quotes, comma, semicolon, and at & or ? before the next
    name of a query string. All marks inside one bare literal form pairs (``auth: pwd=...``); their
    literals end together and share the further terms, so they come as one group and are read once.
    """
    heads: list[tuple[str, int]] = []
    begin = end = stop = 0
    rest: list[tuple[int, int, bool]] = []
    for mark in MARK.finditer(text):
        i = mark.start()
        while i and text[i - 1] in " \t":
            i -= 1
        if i and text[i - 1] in "\"'":
            i -= 1
        last = i
        while i and (text[i - 1].isalnum() or text[i - 1] in "_.-"):
            i -= 1
        name = text[i:last]
        if not name or not any(c.isalpha() for c in name):
            continue
        at = mark.end()
        while at < len(text) and text[at] in " \t":
            at += 1
        if heads and begin <= at < end:
            heads.append((name, at))
            continue
        if not (m := LITERAL.match(text, at)):
            continue
        if heads:
            yield heads, stop, False, rest
            heads = []
        if m[3] is None:
            a, b = m.span(1 if m[1] is not None else 2)
            yield [(name, a)], b, True, sum_rest(text, m.end())
        else:
            begin, end = m.span()
            stop = begin + len(m[3].rstrip(".:!?"))
            heads, rest = [(name, at)], sum_rest(text, end)
    if heads:
        yield heads, stop, False, rest


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Literals that reach a sensitive name, directly or through constants."""
    if "=" not in text and ":" not in text:
        return []
    known: dict[str, Node] = {}
    made: list[Node] = []  # terms come before what refers to them

    def add(*args) -> Node:
        made.append(Node(*args))
        return made[-1]

    for heads, stop, quoted, rest in name_literal_pairs(text):
        tail, after = [], Value()
        for a, b, is_name in rest:
            term = known.get(text[a:b]) if is_name else None
            tail.append(term or add(Value.of(text[a:b]), (a, b)))
            after.then(tail[-1].value)
        terms = (add(after, None, tuple(tail)),) if tail else ()
        last = known.get(text[heads[-1][1] : stop]) if not quoted else None
        own = [(name, a) for name, a in heads if quoted or a < stop]
        plain = own[:-1] if last and own and own[-1] == heads[-1] else own
        values = suffix_values(text, [a for _, a in plain], stop, after)
        for (name, a), value in zip(plain, values, strict=True):
            _bind(known, name, add(value, (a, stop), terms), threshold)
        if len(plain) < len(own):  # the last literal is a constant's name
            _bind(known, heads[-1][0], add(last.value.copy().then(after), None, (last, *terms)), threshold)
        for name, _ in heads[len(own) :] if terms else ():  # no literal of their own
            _bind(known, name, add(after, None, terms), threshold)
    best: dict[tuple[int, int], float] = {}
    for node in reversed(made):
        for term in node.terms:
            term.score = max(term.score, node.score)
        if node.span and node.score and node.span[1] > node.span[0]:
            best[node.span] = max(best.get(node.span, 0.0), node.score)
    return [("literal", a, b, s) for (a, b), s in best.items()]


def _bind(known: dict[str, Node], name: str, node: Node, threshold: float) -> None:
    """A name stands for a node from here on; a sensitive name scores it."""
    known[name] = known[name.rpartition(".")[2]] = node
    score = sensitivity(name) * node.value.strength()
    if score >= threshold:
        node.score = max(node.score, score)


def scan_text(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind as listed; a lexed literal that base spans cover wholly is not repeated."""
    base = base_spans(text)
    more = lexed_spans(text, threshold)
    if base and more:
        taken = np.zeros(len(text) + 1, np.int32)
        for _, a, b, _ in base:
            taken[a:b] = 1
        upto = np.concatenate(([0], np.cumsum(taken)))
        more = [x for x in more if upto[x[2]] - upto[x[1]] < x[2] - x[1]]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, end exclusive, score): one row per document.

    Null and empty texts have no spans. Rows are independent: repeated rows, null ids and extra columns
    need no care, and texts of any length are read whole.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in scan_text(t.as_py() or "", threshold)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, SPAN_SCHEMA)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text, n_literal."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), of("literal"))
