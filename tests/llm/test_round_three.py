"""Personal data, hard negatives and token alignment against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from apsidal.llm import hard_negatives, personal_data, queries, token_alignment
from tests.oracle import mismatch

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ODD = [
    None, "", " ", "a@b.c@d.e x@y @z.q a@b@c.d.e. %+@-.-", "é@b.cc naïve.x@y-.z.", "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.001 1.2.3. 1..2.3.4", "4539 1488-0343 6467 45391488034364670 4539  1488 0343 6467",
    "+1 (858) 555-2896 ++12345678 +1+234567890 +1 ( ) 2 +123456789012345678", "9" * 5000, "1.2." * 500, "a@" * 500 + "b.c", "12 " * 400, "x" * 60_000 + "@" + "y" * 60_000 + ".z", "tel:+1 555 010 2000,+1 555 010 2001\n^ 7", "٣٣٣.1.1.1.1 ▁ <s> <0x41> \x00",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(10**9 + i if i != 3 else None, t) for i, t in enumerate(ODD)]
    odd = spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string")
    return own.unionByName(odd).withColumns({"spans": F.lit(1), "row": F.lit("clash"), "key": F.lit(2)}).cache()


def test_personal_base(docs):
    want = Counter((r.doc_id, tuple(base(r.text or ""))) for r in docs.collect())
    got = Counter((r.doc_id, tuple(tuple(s) for s in r.spans if not s.kind.startswith("found"))) for r in personal_data.find_personal_data(docs).collect())
    assert got == want


@pytest.mark.parametrize("text", ["x" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" * 100_000, "a@" * 100_000, "(1)" * 50_000, "1" + "(" * 100_000, "a1:" * 50_000, "+1" + " " * 100_000])
def test_personal_scan_is_linear(text):
    import time

    began = time.process_time()
    personal_data.scan_text(text)
    assert time.process_time() - began < 5


def contextual(texts):
    """Found spans by the definition: patterns and instances as sets, rounds until nothing is new."""
    seen = [(i, s) for i, t in enumerate(texts) for s in personal_data.scan_text(t)[1]]
    inside, places = {}, {}
    fits, known = {}, {}
    for _, s in seen:
        fits[s["inst"]] = fits.get(s["inst"], 0) | s["fits"]
        places.setdefault(s["inst"], []).append(set(s["pats"]))
        for p in s["pats"]:
            inside.setdefault(p, set()).add(s["inst"])
        for k in range(4):
            if s["seed"] >> k & 1:
                known.setdefault(s["inst"], set()).add(k)
    while True:
        trusted = set()
        for p, members in inside.items():
            for k in range(4):
                yes = sum(k in known.get(i, ()) for i in members)
                no = sum(bool(known.get(i)) and k not in known[i] for i in members)
                if yes >= 3 and yes >= 0.7 * (yes + no + 0.5 * (len(members) - yes - no)):
                    trusted.add((p, k))
        new = []
        for i, own in places.items():
            for k in range(4):
                share = sum(any((p, k) in trusted for p in ps) for ps in own)
                if share and share >= 0.5 * len(own) and fits[i] >> k & 1 and k not in known.get(i, ()):
                    new.append((i, k))
        if not new:
            break
        for i, k in new:
            known.setdefault(i, set()).add(k)
    out = Counter()
    for n, s in seen:
        if not s["seed"] and known.get(s["inst"]):
            out[n, f"found_{personal_data.KINDS[min(known[s['inst']])]}", s["start"], s["end"]] += 1
    return out


def test_personal_contexts(spark):
    texts = [f"Phone: +1 555 010 2{i:03d} now" for i in range(12)] + [f"please call 555-010-7{i:03d} soon, phone: 555-010-7{i:03d}" for i in range(4)]
    texts += [f"please call 555 010 8{i:03d} soon" for i in range(2)] + [f"mail to: user{i}@host{i}.example.org" for i in range(4)] + ["mail to: root@localhost", "see root@localhost", "item 5550107777 sold", "phone: 12", "in 2021 phone: 2021"]
    texts += ["Phone: +1 555 010 2000 now"] * 5 + ["", "serial: 4444444444444444"]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    found = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(5))
    got = Counter((r.doc_id, s.kind, s.start, s.end) for r in found.collect() for s in r.spans if s.kind.startswith("found"))
    assert got == contextual(texts)
    values = {(k, texts[n][a:b]) for n, k, a, b in got}
    # learnt from labels first, then from the words around what the labels taught
    assert {("found_phone", "555-010-7000"), ("found_phone", "555 010 8001"), ("found_email", "root@localhost")} <= values
    assert not any(v in ("2021", "5550107777", "4444444444444444", "12") for _, v in values)


def test_personal_trust_needs_different_values(spark):
    """Copies of one number teach nothing: they are one instance."""
    rows = [(i, "desk +1 555 010 2000 here") for i in range(50)] + [(99, "desk 555-010-9999 here")]
    found = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not [s for r in found.collect() for s in r.spans if s.kind.startswith("found")]


def negatives(rows, anchors):
    use = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = Counter()
    for n, (aid, alab, av) in enumerate(use):
        if not anchors(aid):
            continue
        scored = [(sum(x * y for x, y in zip(av, v, strict=False)), i, lab == alab) for m, (i, lab, v) in enumerate(use) if m != n]
        for ps, pid, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            inside = sorted((s for s in scored if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps), key=key)
            for rank, (ns, nid, _) in enumerate(inside[:5], 1):
                out[aid, pid, rank, nid, ps, ns] += 1
    return out


@pytest.mark.parametrize("large", [1.0, 1e6])
def test_hard_negatives(spark, sf_dir, large):
    own = [(r.vec_id, r.label, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(90).collect()]
    zero = [0.0] * 64
    own += [(None, 1, own[0][2]), (200, None, zero), (300, 1, None), (400, 2, [None] * 64), (500, 2, [math.nan] * 64), (600, 3, [math.inf] + [0.0] * 63), (700, 3, []), (800, 4, zero), (900, 4, own[1][2][:10])]
    own += [own[3]] * 12 + [(100, 1, own[2][2])] * 3 + [(-100, -4, own[2][2])] + [(10_000 + i, 5, own[2][2]) for i in range(8)]
    rows = [(i, lab, None if v is None else [None if x is None else x * large for x in v]) for i, lab, v in own]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"anchor": F.lit("clash"), "score": F.lit(0)}).repartition(4)
    for group_bytes in (1 << 25, 1000):
        got = hard_negatives.mine_negatives(df, F.col("vec_id") % 100 == 0, group_bytes=group_bytes)
        assert Counter(tuple(r) for r in got.collect()) == negatives(rows, lambda i: i is not None and i % 100 == 0)


def test_hard_negatives_oracle(spark, sf_dir):
    got, want, first = mismatch(spark, queries.op12_hard_negatives, queries.OP12_SQL, sf_dir)
    assert got == want and not first, first


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.rank_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.rank_file("piece_bpe_32k.model"))


def aligned(rows, coders):
    a, b = coders
    names = {i: n for n, i in a.get_vocab().items()}
    table = token_alignment.byte_table()
    done, counts = [], Counter()
    for doc, text in rows:
        text = text or ""
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [[bytes(table[c] for c in names[i]) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            done.append((doc, [], [], [], []))
            continue
        ends = []
        for r in raw:
            at, own = 0, []
            for t in r:
                at += len(t)
                own.append(at)
            ends.append(own)
        cuts = set(ends[0]) & set(ends[1])
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(cuts):
            i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, ids[0][i:i2])) + "|" + ",".join(map(str, ids[1][j:j2])))
            links += [(ids[0][x], ids[1][y]) for x in range(i, i2) for y in range(j, j2) if max(ends[0][x] - len(raw[0][x]), ends[1][y] - len(raw[1][y])) < min(ends[0][x], ends[1][y])]
            i, j = i2, j2
        counts.update(links)
        done.append((doc, *ids, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter(
        (d, len(x), len(y), len(g), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, ls in done
    )


def test_token_alignment(docs, coders):
    want = aligned([(r.doc_id, r.text) for r in docs.collect()], coders)
    files = queries.rank_file("byte_bpe_50k.json"), queries.rank_file("piece_bpe_32k.model")
    for pairs in (1 << 20, 50):
        assert Counter(tuple(r) for r in token_alignment.align_tokens(docs, *files, broadcast_pairs=pairs).collect()) == want


def test_long_texts_are_encoded_in_pieces(coders, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLAB_CHARS", 40)
    monkeypatch.setattr(token_alignment, "KNOWN_PIECES", 3)
    contents = [open(queries.rank_file(f), "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    pair = token_alignment.Pair(*contents)
    lists = lambda found: [(a.tolist(), b.tolist()) for a, b in found]
    texts = ["it's a plain text with words  and   gaps, that 1 goes on and on " * 9, "x" * 500, "länger über d'un café a b c d e f " * 8]
    texts += ["a' 's 't x'll  'll 1 2 33 -- -a a- \u00a0 b\u2003 c \x1c d\x85 e \u3000f", " lead and trail ", "漢字 かな 한글 ١٢ 3", "end\n x\ty \n z", "\u200b \u2060 \ufeff q"]
    assert all(len(pair.pieces(t)) > 3 for t in (texts[0], texts[2]))
    for _ in range(2):
        assert all(lists(pair.encode([t])) == lists(pair.encode([t, t]))[:1] for t in texts)
    assert lists(pair.encode(texts)) == [(coders[0].encode(" " + t, add_special_tokens=False).ids, coders[1].encode(t)) for t in texts]
