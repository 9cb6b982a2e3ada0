"""HTML main-text extraction by union-free wrapper inference over the pages of a host.

A page becomes a token stream of block elements and text slots. Tandem repeats in the stream fold into
repeated groups; the streams of a host are aligned one after another, and whatever has no counterpart
becomes an optional group, whatever text differs becomes a slot. The result, one wrapper per host, is a
regular expression without unions, held as a tree. The wrapper says which part of a page is the article:
the named main element, or else the part that carries the varying text. A page is extracted by aligning
it with its host's wrapper. Text that is the same on all pages stays where a named element marks it as
article, since nothing of an article may be dropped; without such names it belongs to the template.

Scale: pages are never gathered by host. Pages of one host whose folded streams have the same structure
differ in their slots only; a task sums them up, and so does the merge, in any order. The distinct
structures of a host are then aligned in rounds of small groups that their hashes and not the tasks
determine, so the wrapper does not depend on how the table is split, and a host with a third of all
pages costs one small tree per structure. Wrappers are broadcast after counting them; beyond the bound
they are joined with salted keys. The html is read twice and never shuffled unless that bound is passed.
"""

from __future__ import annotations

import html as htmllib
import json
import re
import sys
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Elements whose contents are no text of the page; the first ones leave no gap in the text around them.
UNSEEN = ("script", "style", "noscript", "template")
RAW = re.compile(r"(script|style|noscript|template|textarea|svg|iframe|object)\b", re.IGNORECASE)
RAW_ENDS = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in (*UNSEEN, "textarea", "svg", "iframe", "object")}
TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
UNQUOTED = re.compile(r"""[^>"']*""")
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HOST = re.compile(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Elements that flow inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img picture source input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening element of the key ends an open element of these names.
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements, and words in class, id and role, that are not the article.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SIDE_TAGS = frozenset("head nav aside footer form button select dialog menu".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that side words may stand with in one name and still mean a side part (``related-posts``, ``cookie-box``).
PLAIN_WORDS = frozenset(
    "area article aside bar block body bottom box button buttons center col column container content entry global group header heading icons inner inline item items left link links list main message module outer page panel post posts primary right row secondary section site slot social sticky stories story text title top unit wrap wrapper".split()
)
#: Roles of side parts.
SIDE_ROLES = frozenset("alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words that name the article's container where no article or main element does.
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
PERIODS = (1, 2, 3, 4)
#: A slot whose text is the same on so many pages belongs to the template.
CONSTANT_PAGES = 3
MERGE_GROUP, TASK_HOSTS = 32, 2000
#: Elements nest as deep as a page has them; trees are walked by plain Python calls, which need no C stack.
RECURSION = 10_000_000
#: Characters of wrappers that are broadcast at most.
BROADCAST_CHARS = 32 << 20
SALTS = 64


def host_of(url: str | None) -> str:
    m = HOST.match((url or "").strip())
    return m[1].lower() if m else ""


def label_words(tag: str, attrs: str) -> list[str]:
    """Words of class, id and role, sorted; side words only where a whole name says side part.

    A whole name does where all its words are side words or plain ones (``sidebar``, ``cookie-box``), not
    where it says what is beside or about it (``has-sidebar``, ``no-comments``, ``related-work``). Ids of
    headings are places to link to and say nothing. Roles count by a list of their own. An article element
    is a side part only where a name holds nothing but side words, and none of its names says main.
    """
    words: set[str] = set()
    tokens = []
    for kind, *values in NAMES.findall(attrs):
        kind, value = kind.lower(), "".join(values)
        if kind == "role":
            for role in value.lower().split():
                words |= {"navigation"} if role in SIDE_ROLES else {role} & MAIN_WORDS
        elif kind == "class" or tag not in HEADINGS:
            tokens += [{w.lower() for w in NAME_PART.findall(t)} for t in value.split()]
    every = set().union(*tokens)
    words |= every - SIDE_WORDS
    if not SIDE_WORDS.isdisjoint(every):
        named = any(SIDE_WORDS.isdisjoint(t) and not MAIN_WORDS.isdisjoint(t) for t in tokens)
        alone = tag == "article" or named
        for t in tokens:
            if not SIDE_WORDS.isdisjoint(t) and t <= SIDE_WORDS | (frozenset() if alone else PLAIN_WORDS) and not (named and tag == "article"):
                words |= t & SIDE_WORDS
    return sorted(words)


def markup(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in order: text, unseen or gap (an element without text of the page), open, close.

    One pass: where a search finds no further > or quote, that is remembered. Broken tags are text. Once a
    tag's quotes run to the end of the page without a >, tags end at the next >, quoted or not.
    """
    at, n, broken, last = 0, len(source), False, source.rfind(">")
    while at < n:
        lt = source.find("<", at)
        if lt != at:
            yield "text", "", source[at : lt if lt >= 0 else n]
            if lt < 0:
                return
        at = lt + 1
        if source.startswith("!--", at):
            end = source.find("-->", at + 3)
            at = end + 3 if end >= 0 else n
            yield "unseen", "", ""
        elif at > last:
            yield "text", "", "<"
        elif source[at] in "!?":
            at = source.find(">", at) + 1
            yield "unseen", "", ""
        elif m := RAW.match(source, at):
            name = m[1].lower()
            end = RAW_ENDS[name].search(source, source.find(">", m.end()) + 1)
            at = end.end() if end else n
            yield ("unseen" if name in UNSEEN else "gap"), name, ""
        elif m := TAG.match(source, at):
            end = -1 if broken else tag_end(source, m.end())
            broken = broken or end < 0
            end = end if end >= 0 else source.find(">", m.end())
            at = end + 1
            yield ("close" if m[1] else "open"), m[2].lower(), source[m.end() : end]
        else:
            yield "text", "", "<"


def tag_end(source: str, at: int) -> int:
    """Place of the > that ends a tag, outside quotes; -1 if there is none."""
    while True:
        at = UNQUOTED.match(source, at).end()
        if at == len(source):
            return -1
        if source[at] == ">":
            return at
        at = source.find(source[at], at + 1) + 1
        if not at:
            return -1


class Page:
    """Elements as [label, children]; a child is an element or the number of a text block."""

    def __init__(self, source: str) -> None:
        self.texts: list[str] = []
        self.root: list = ["#root", []]
        stack, buf = [self.root], []
        places: dict[str, list[int]] = {}  # of each open element's name, its places in the stack

        def flush() -> None:
            if buf:
                text = " ".join(htmllib.unescape("".join(buf)).split())
                buf.clear()
                if text:
                    stack[-1][1].append(len(self.texts))
                    self.texts.append(text)

        def innermost(names: Iterable[str]) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        def close(names: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
            at = innermost(names)
            if at and at > innermost(until):
                flush()
                while len(stack) > at:
                    places[stack.pop()[0].partition(".")[0]].pop()

        for kind, name, attrs in markup(source):
            if kind == "text":
                buf.append(attrs)
                continue
            if kind in ("unseen", "gap"):
                if kind == "gap":
                    buf.append(" ")
                continue
            if kind == "close":
                close((name,))
                continue
            words = label_words(name, attrs) if attrs else []
            if name in INLINE and (name in VOID or SIDE_WORDS.isdisjoint(words)):
                if name == "br":
                    buf.append(" ")
                continue
            flush()
            if name in P_ENDS:
                close(("p",), ("td", "th", "button"))
            if name in SIBLINGS:
                close(SIBLINGS[name], ("ul", "ol", "dl", "table", "select", "menu"))
            if name == "body":
                close(("head",))
            if name in VOID or attrs.endswith("/"):
                continue
            node = [name + "." + ".".join(words) if words else name, []]
            stack[-1][1].append(node)
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
        flush()
        self._open_forms()

    def _open_forms(self) -> None:
        """A form around an article or a named main part, as some frameworks put around whole pages, is a plain container."""
        order, todo = [], [(self.root, None)]
        while todo:
            node, above = todo.pop()
            order.append((node, above))
            todo += [(k, node) for k in node[1] if not isinstance(k, int)]
        holds: set[int] = set()
        for node, above in reversed(order):
            tag, _, names = node[0].partition(".")
            if tag == "form" and id(node) in holds:
                node[0] = ".".join(["div", *(w for w in names.split(".") if w not in ("", "form"))])
            if above is not None and (id(node) in holds or main_rank(node[0]) is not None) and not is_side(node[0]):
                holds.add(id(above))


class Node:
    """A part of a wrapper: an element with children, or a text slot (label #) with what its texts are like."""

    __slots__ = ("label", "optional", "repeated", "kids", "low", "high", "chars", "pages", "source", "main")

    def __init__(self, label: str) -> None:
        self.label, self.optional, self.repeated, self.kids = label, False, False, []
        self.low = self.high = None
        self.chars = self.pages = 0
        self.source: list[int] = []
        self.main = False

    def pack(self) -> list:
        """The tree in preorder, each part with its number of children."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            own = [n.label, len(n.kids), int(n.optional), int(n.repeated), int(n.main)]
            out.append([*own, n.low, n.high, n.chars, n.pages] if n.label == "#" else own)
            todo += reversed(n.kids)
        return out

    @staticmethod
    def unpack(rows: list) -> Node:
        stack: list[tuple[Node, int]] = []
        root = None
        for label, size, optional, repeated, main, *slot in rows:
            n = Node(label)
            n.optional, n.repeated, n.main = bool(optional), bool(repeated), bool(main)
            if slot:
                n.low, n.high, n.chars, n.pages = slot
            while stack and len(stack[-1][0].kids) == stack[-1][1]:
                stack.pop()
            if stack:
                stack[-1][0].kids.append(n)
            root = root or n
            stack.append((n, size))
        return root

    def forget(self) -> None:
        """Drop the numbers of the text blocks of a page."""
        todo = [self]
        while todo:
            n = todo.pop()
            n.source = []
            todo += n.kids

    def structure(self) -> str:
        """The tree without what its slots hold."""
        return json.dumps([x[:4] for x in self.pack()])


def alike(a: Node, b: Node) -> bool:
    """Same label; bare containers must share half of their children's labels too, or they are different parts."""
    if a.label != b.label:
        return False
    if a.label not in ("div", "section", "td"):
        return True
    x, y = {k.label for k in a.kids}, {k.label for k in b.kids}
    return 2 * len(x & y) >= len(x | y)


def fold(kids: list[Node]) -> list[Node]:
    """Tandem repeats of up to four neighbours become one repeated group."""
    out: list[Node] = []
    for kid in kids:
        out.append(kid)
        for p in PERIODS:
            if len(out) >= 2 * p and all(alike(out[-p + i], out[-2 * p + i]) for i in range(p)):
                for i in range(p):
                    join(out[-2 * p + i], out[-p + i], True)
                    out[-2 * p + i].repeated = True
                del out[-p:]
                break
    return out


def join(a: Node, b: Node, same_pages: bool = False) -> None:
    """Generalise a so that it also matches b, which has the same label; repeats within pages count no page twice."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.source += b.source
    if a.label == "#":
        a.low, a.high = min(a.low, b.low), max(a.high, b.high)
        a.chars += b.chars
        a.pages = max(a.pages, b.pages) if same_pages else a.pages + b.pages
        return
    x, y = [k.label for k in a.kids], [k.label for k in b.kids]
    if x == y:
        for k, m in zip(a.kids, b.kids, strict=True):
            join(k, m, same_pages)
        return
    kids = []
    for op, i, j, s, t in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            for k, m in zip(a.kids[i:j], b.kids[s:t], strict=True):
                join(k, m, same_pages)
            kids += a.kids[i:j]
        else:
            rest = a.kids[i:j] + b.kids[s:t]
            for k in rest:
                k.optional = True
            kids += rest
    a.kids = fold(kids)


def shape(page: Page) -> Node:
    """The folded stream of one page; slots remember their text blocks."""
    import xxhash

    def walk(node: list) -> Node:
        out, kids = Node(node[0]), []
        for child in node[1]:
            if isinstance(child, int):
                slot = Node("#")
                slot.low = slot.high = xxhash.xxh64_intdigest(page.texts[child])
                slot.chars, slot.pages, slot.source = len(page.texts[child]), 1, [child]
                kids.append(slot)
            else:
                kids.append(walk(child))
        out.kids = fold(kids)
        return out

    return walk(page.root)


def is_side(label: str) -> bool:
    tag, _, names = label.partition(".")
    if tag in SIDE_TAGS:
        return True
    return bool(names) and tag not in ("html", "body", "main", "#root") and not SIDE_WORDS.isdisjoint(names.split("."))


def main_rank(label: str) -> int | None:
    """0 for an article, 1 for a main element, 2 for a container that a word names, None for others."""
    tag, _, names = label.partition(".")
    words = names.split(".")
    if tag in ("html", "body", "#root"):
        return None
    return 0 if tag == "article" else 1 if tag == "main" or "main" in words else 2 if not MAIN_WORDS.isdisjoint(words) else None


def varies(slot: Node) -> bool:
    """Whether a slot's text differs between pages, or is not on enough of them to tell."""
    return slot.low != slot.high or slot.pages < CONSTANT_PAGES


def varying(node: Node, every: bool = True) -> int:
    """Characters in the slots below that are not beside the article; without ``every``, of varying slots only."""
    total, todo = 0, [node]
    while todo:
        n = todo.pop()
        if n.label == "#":
            total += n.chars if every or varies(n) else 0
        elif not is_side(n.label):
            todo += n.kids
    return total


def mark_main(root: Node) -> None:
    """Mark the slots of the article: of all outermost containers of the best rank that has text."""
    found: dict[int, list[Node]] = {0: [], 1: [], 2: []}
    hidden: list[Node] = []  # outermost article and main elements inside side parts

    def look(node: Node, within: frozenset[int], beside: bool) -> None:
        for k in node.kids:
            if k.label == "#":
                continue
            rank, side = main_rank(k.label), is_side(k.label)
            if beside or side:
                if not side and rank in (0, 1):
                    hidden.append(k)
                elif k.label.partition(".")[0] not in SIDE_TAGS:
                    look(k, within, True)
            elif rank is None or rank in within:
                look(k, within, False)
            else:
                found[rank].append(k)
                look(k, within | {rank}, False)

    look(root, frozenset(), False)
    tops = next((some for rank in sorted(found) if (some := [k for k in found[rank] if varying(k)])), [])
    if not tops and hidden and sum(map(varying, hidden)) > varying(root):
        tops = [k for k in hidden if varying(k)]  # named as beside the article, but the page has no more than that
    named = bool(tops)
    best = root
    held: dict[int, int] = {}  # varying characters of every part, each part summed once

    def weigh(node: Node) -> int:
        held[id(node)] = (node.chars if varies(node) else 0) if node.label == "#" else sum([weigh(k) for k in node.kids])
        if is_side(node.label):
            held[id(node)] = 0
        return held[id(node)]

    def mass(node: Node) -> int:
        return held[id(node)]

    if not named:
        weigh(root)
    while not named:
        total = mass(best)
        inner = max((k for k in best.kids if k.label != "#"), key=mass, default=None)
        if inner is None or not total or mass(inner) < 0.8 * total or all(k.label == "#" for k in inner.kids):
            break
        best = inner
    some = named or mass(best) > 0

    def mark(node: Node) -> None:
        node.main = True
        for k in node.kids:
            if k.label == "#":
                k.main = named or not some or varies(k)
            elif not is_side(k.label) and (named or k.label.partition(".")[0] != "header"):
                mark(k)

    for top in tops or [best]:
        mark(top)


def matched(page: Node, wrapper: Node, within: bool = False) -> list[int]:
    """Text blocks of a page that the wrapper takes for the article."""
    out: list[int] = []

    def whole(node: Node) -> None:  # a part that the wrapper doesn't know
        if node.label == "#":
            out.extend(node.source)
        elif not is_side(node.label):
            for k in node.kids:
                whole(k)

    def walk(p: Node, w: Node) -> None:
        if p.label == "#":
            if w.main:
                out.extend(p.source)
            return
        x, y = [k.label for k in p.kids], [k.label for k in w.kids]
        if x == y:
            for k, m in zip(p.kids, w.kids, strict=True):
                walk(k, m)
            return
        for op, i, j, s, t in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if op == "equal":
                for k, m in zip(p.kids[i:j], w.kids[s:t], strict=True):
                    walk(k, m)
            elif w.main:
                for k in p.kids[i:j]:
                    whole(k)

    walk(page, wrapper)
    return sorted(out)


def main_text(source: str, wrapper: Node | None) -> str:
    """Blocks of the article, joined by newlines; a page without the wrapper's article is its own wrapper."""
    sys.setrecursionlimit(RECURSION)
    page = Page(source)
    own = shape(page)
    kept = matched(own, wrapper) if wrapper is not None else []
    if not kept:
        mark_main(own)
        kept = matched(own, own)
    return "\n".join(page.texts[i] for i in kept)


def fit_wrapper(pages: list[str]) -> Node:
    """Wrapper of pages of one host: alike structures summed up, then aligned in the order of their structures."""
    sys.setrecursionlimit(RECURSION)
    known: dict[str, Node] = {}
    for source in pages:
        own = shape(Page(source))
        at = own.structure()
        if at in known:
            join(known[at], own)
        else:
            known[at] = own
    return aligned([known[k] for k in sorted(known)])


def aligned(parts: list[Node]) -> Node:
    for other in parts[1:]:
        join(parts[0], other)
    return parts[0]


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON): one row per host, its article marked."""
    import xxhash

    kind = "host string, structure long, wrapper string"

    def rows(known: dict[tuple[str, str], Node]) -> pa.RecordBatch:
        names = [pa.array([h for h, _ in known], pa.string()), pa.array([xxhash.xxh64_intdigest(s) >> 1 for _, s in known], pa.int64())]
        return pa.RecordBatch.from_arrays([*names, pa.array([json.dumps(w.pack()) for w in known.values()], pa.string())], names=["host", "structure", "wrapper"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(RECURSION)
        known: dict[tuple[str, str], Node] = {}
        for b in batches:
            for url, source in zip(b.column(0), b.column(1), strict=True):
                own = shape(Page(source.as_py() or ""))
                at = host_of(url.as_py()), own.structure()
                if at in known:
                    join(known[at], own)
                else:
                    known[at] = own
                known[at].forget()
                if len(known) > TASK_HOSTS:
                    yield rows(known)
                    known = {}
        if known:
            yield rows(known)

    def merge(key, group):
        sys.setrecursionlimit(RECURSION)
        nodes = sorted(((n.structure(), n) for n in (Node.unpack(json.loads(w)) for w in group["wrapper"])), key=lambda x: x[0])
        group = group.iloc[:1].copy()
        root = aligned([n for _, n in nodes])
        group["structure"], group["wrapper"] = [xxhash.xxh64_intdigest(root.structure()) >> 1], [json.dumps(root.pack())]
        return group[["host", "structure", "wrapper"]]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(RECURSION)
        for b in batches:
            done = []
            for w in b.column(2):
                root = Node.unpack(json.loads(w.as_py()))
                mark_main(root)
                done.append(json.dumps(root.pack()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["host", "wrapper"])

    src = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parts = checkpoint(src.mapInArrow(fit, kind))
    # what tasks found of one structure sums up in any order; few rows, as a task has one per structure
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_GROUP)).alias("salt")
    parts = parts.groupBy("host", "structure", salt).applyInPandas(merge, kind).groupBy("host", "structure").applyInPandas(merge, kind)
    parts = checkpoint(parts)
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        dealt = parts.withColumn("part", F.pmod("structure", F.lit(-(-most // MERGE_GROUP))))
        parts = checkpoint(dealt.groupBy("host", "part").applyInPandas(merge, kind))
    return parts.mapInArrow(finish, "host string, wrapper string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    Broken markup is read in linear time. Null or empty html gives an empty text; a null or odd url counts as the host without a name.
    Repeated rows, null ids and extra columns need no care. An empty table gives an empty result.
    """
    wrappers = checkpoint(infer_wrappers(pages, url_col, html_col))
    chars = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.coalesce(F.lower(F.nullif(F.regexp_extract(F.trim("url"), f"^{HOST.pattern}", 1), F.lit(""))), F.lit(""))
    src = src.withColumn("__host", host)
    if chars <= broadcast_chars:
        met = src.join(F.broadcast(wrappers), F.col("__host") == F.col("host"), "left")
    else:  # salted: a host's pages spread over SALTS tasks, the small trees are repeated
        salted = wrappers.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        src = src.withColumn("__s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        met = src.join(salted, (F.col("__host") == F.col("host")) & (F.col("__s") == F.col("__salt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Node | None] = {None: None}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, texts = b.slice(at, 512), []
                for source, w in zip(part.column(2), part.column(3), strict=True):
                    w = w.as_py()
                    if w not in known:
                        if len(known) > TASK_HOSTS:
                            known = {None: None}
                        known[w] = Node.unpack(json.loads(w))
                    texts.append(main_text(source.as_py() or "", known[w]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
