"""Each operator on small tables with nulls, empty texts, ties, repeated rows and clashing extra columns,
against brute force; and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import backoff_lm, decontam, host_text, langid, lz, orc_ids, packing, pii, set_join, textvec, tokens, warc
from loomgraph.llm.common import shared_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{i}" for i in range(60)]


def text(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = text(1, 120)
EDITED = " ".join([*BASE.split()[:60], "changed", *BASE.split()[61:]])
DOCS = [
    (1, BASE), (2, BASE), (3, EDITED), (4, text(2, 80)), (5, None), (6, ""), (7, "  \n "), (8, "one"), (9, "One"), (10, "two words"),
    (11, text(3, 3000)), (12, "mail bob@x.org or +44 20 7946 0958, card 4111 1111 1111 1111 at 10.0.0.1"), (None, text(4, 30)), (13, "ÀÉ ñandú 12% — ok"), (14, text(2, 80)), (14, text(2, 80)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, "en", "s", 0, 9, "x", b"") for a, b in DOCS], "doc_id long, text string, lang string, source string, n_chars long, block int, n string, z binary")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_set_join(docs, none):
    sets = {}
    for i, (_, t) in enumerate(DOCS):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    want = []
    for i, (d, _) in enumerate(DOCS):
        ids = [DOCS[j][0] for j in sets if root[j] == root[i] and DOCS[j][0] is not None]
        want.append((d, len(sets[i]), min(ids) if ids else None))
    assert key(set_join.components(docs).collect()) == key(want)
    assert set_join.components(none).collect() == []
    kept = [r.doc_id for r in set_join.keep_one(docs).collect()]
    assert sorted(x for x in kept if x) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13] and None in kept


@pytest.mark.parametrize("words, percent, low, high", [(3, 90, 0, 4), (5, 80, 1, 6), (1, 60, 4, 30)])
def test_set_join_of_families(spark, monkeypatch, words, percent, low, high):
    """Families of a template: members near the threshold and under it, so that lists stay mixed and blocks meet."""
    monkeypatch.setattr(set_join, "LIST_BLOCK", 4)
    rng = np.random.default_rng(words)
    rows = []
    for family in range(4):
        base = text(100 + family, 90).split()
        for _ in range(30):
            t = list(base)
            for i in rng.integers(0, 90, rng.integers(low, high)):
                t[i] = f"x{rng.integers(1000)}"
            rows.append(" ".join(t[: 90 - rng.integers(0, 6)]))
    sets = [{tuple(t.split()[j : j + words]) for j in range(len(t.split()) - words + 1)} for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = set_join.components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), words, percent, 4000).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root)) and len(set(root)) > 4


def test_components_by_contraction(spark, monkeypatch):
    """Long paths, stars, cliques and random links, all at once and added to labels; edges within a component move once."""
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(40)] + [(99, i) for i in range(50, 70)] + [(i, j) for i in range(200, 230) for j in range(200, i)] + [tuple(p) for p in rng.integers(300, 400, (60, 2)).tolist() if p[0] != p[1]]
    name = {i: f"{x:05}" for i, x in enumerate(rng.permutation(400).tolist())}
    root = {x: x for p in pairs for i in p for x in (name[i],)}
    for a, b in pairs * 2:
        low, high = sorted((root[name[a]], root[name[b]]))
        root = {k: low if v == high else v for k, v in root.items()}
    edges = [(name[a], name[b]) for a, b in pairs]
    moved, between = [], set_join._between
    monkeypatch.setattr(set_join, "_between", lambda e, labels: moved.append(e.count()) or between(e, labels))
    table = lambda rows: spark.createDataFrame(rows, "a string, b string")
    assert dict(map(tuple, set_join.connected(table(edges)).collect())) == root
    assert len(moved) > 1 and sum(moved[1:]) < moved[0] / 2  # before, every round joined all edges
    order = rng.permutation(len(edges)).tolist()
    some, rest = (table([edges[i] for i in part]) for part in (order[:250], order[250:]))
    labels = set_join.joined_labels(set_join.connected(some), rest)
    assert dict(map(tuple, labels.collect())) == root and labels.count() == len(root)
    assert set_join.connected(table(edges).where("false")).collect() == []


def test_rows_of_one_id_are_told_apart(spark):
    """Near copies and contaminated rows go for their own texts, not for those of rows with the same id or none."""
    rows = [(1, BASE), (1, text(20, 60)), (2, EDITED), (2, text(21, 60)), (2, text(21, 60)), (None, BASE), (None, text(22, 60)), (3, " "), (3, "")]
    docs = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in set_join.keep_one(docs).collect()]
    assert key(kept) == key([(1, BASE), (1, text(20, 60)), (2, text(21, 60)), (None, BASE), (None, text(22, 60)), (3, " "), (3, "")])
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[20:45]))], "item_id long, text string")
    clean = [(r.doc_id, r.text) for r in decontam.clean(docs, bench).collect()]
    assert key(clean) == key([x for x in rows if x[1] not in (BASE, EDITED)])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_lm(spark, docs, none, monkeypatch, order):
    """Against the formula, with lanes of a few tokens, in one block and in several."""
    monkeypatch.setattr(backoff_lm, "LANE", 7)
    rows = [(d, t) for d, t in DOCS] + [(100 + i, " ".join(np.random.default_rng(i).choice(WORDS[:6], 40))) for i in range(20)]
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"] for _, t in rows]
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    count = Counter()
    for t, held in zip(toks, out, strict=True):
        if not held:
            padded = ["<s>", *t]
            count[("<s>",)] += 1
            for k in range(1, order + 1):
                count.update(tuple(padded[i - k + 1 : i + 1]) for i in range(1, len(padded)) if i - k + 1 >= 0)
    n = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
    v = sum(1 for g in count if len(g) == 1 and g != ("<s>",))

    def p(w, h):
        if not h:
            return (count[(w,)] + 1) / (n + v + 1)
        c = count[tuple(h)]
        return (count[(*h, w)] + backoff_lm.M * p(w, h[1:])) / (c + backoff_lm.M) if c >= min(2, len(h)) else p(w, h[1:])

    want = []
    for (d, _), t, held in zip(rows, toks, out, strict=True):
        padded = ["<s>", *t]
        base = [math.log10(p(w, ())) for w in t]
        full = [math.log10(p(padded[i], padded[max(0, i - order + 1) : i])) for i in range(1, len(padded))]
        want.append((d, held, len(t), sum(count[(w,)] > 0 for w in t), n, round(sum(base), 6), round(sum(full), 6)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(DOCS) :], "doc_id long, text string")).withColumn("held_out", backoff_lm.held_out()).withColumn("block", F.lit(1))
    for size in (backoff_lm.BLOCK_BYTES, 4000):
        got = backoff_lm.score(df, order, block_bytes=size).collect()
        assert key([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in got]) == key(want)
    assert backoff_lm.score(none.withColumn("held_out", backoff_lm.held_out()), order).collect() == []


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_words_are_told_apart():
    """Words that a polynomial modulo 2**64 takes for one, words over all lengths of lanes, words longer than a slice."""
    x = thue_morse(10)
    y = x.translate(str.maketrans("ab", "ba"))
    e = tokens.encoder(tokens.vocabulary_path())
    ids, at = e.encode_all([x, y])
    for i, t in enumerate((x, y)):
        assert ids[at[i] : at[i + 1]].tolist() == e.whole.encode(t, add_special_tokens=False).ids
    words = [x, y, x[:512], y[:512], *("a" * n for n in range(1, 40)), *("b" * n + "\0" for n in range(20)), *("c" * 8 * n for n in range(1, 90)), "é" * 300]
    h, o = textvec.word_hashes([" ".join(words), "d" * (textvec.SLICE * 2) + " e " + " ".join(words)])
    assert len(set(h.tolist())) == len(words) + 2 and (h[: len(words)] == h[len(words) + 2 :]).all() and o.tolist() == [0, len(words), len(h)]
    cut_, _ = textvec.word_hashes(["d" * 100], longest=16)
    assert len(cut_) == 7 and len(set(cut_.tolist())) == 2


def test_long_and_equal_words_in_decontamination():
    bench = decontam.Benchmark(["a"], ["x " * 300], 10)
    n, found = decontam.shard_hits(["x " * 20_000 + "y"], bench)
    assert n.tolist() == [20_001] and decontam.united(found[0][0]) == [0, 20_000] and found[0][2] == 300


def test_longest_matches():
    rng = np.random.default_rng(1)
    for _ in range(40):
        texts, items = ([" ".join(rng.choice(list("abc"), rng.integers(0, n))) for _ in range(4)] for n in (40, 30))
        bench = decontam.Benchmark(list("wxyz"), items, 4)
        _, found = decontam.shard_hits(texts, bench)
        for i, t in enumerate(texts):
            t, hit, which, longest = t.split(), set(), set(), 0
            for j, x in enumerate(items):
                x = x.split()
                k = min(4, len(x))
                for p in range(len(t) - k + 1 if k else 0):
                    for q in range(len(x) - k + 1):
                        n = 0
                        while p + n < len(t) and q + n < len(x) and t[p + n] == x[q + n]:
                            n += 1
                        if n >= k:
                            hit.update(range(p, p + k))
                            which.add(j)
                            longest = max(longest, n)
            spans, got, n = found.get(i, ([], set(), 0))
            u = decontam.united(spans)
            assert (sum(u[1::2]) - sum(u[::2]), got, n) == (len(hit), which, longest)


def test_tokens_equal_the_library():
    e = tokens.encoder(tokens.vocabulary_path())
    odd = [None, "", " ", "a", "İstanbul Σας don't", "x<|endoftext|>y", "日本語 text 12", "a\x1cb c\x85d", "é́e 1²3 ½ ªº", "“q” – a…", "ǆ", *[t for _, t in DOCS]]
    ids, at = e.encode_all(odd)
    for i, t in enumerate(odd):
        assert ids[at[i] : at[i + 1]].tolist() == e.whole.encode(t or "", add_special_tokens=False).ids


def expected_ids(end):
    e = tokens.encoder(tokens.vocabulary_path())
    return [(d, [*e.whole.encode(t or "", add_special_tokens=False).ids, end]) for d, t in DOCS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_orc_round_trip(spark, docs, none):
    path = shared_path(spark, "test-orc")
    orc_ids.write_ids(docs, path)
    got = sorted(orc_ids.digest(orc_ids.read_ids(spark, path)).collect(), key=lambda r: r.start)
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((d, len(x), crc(x)) for d, x in expected_ids(2))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and got[0].doc_id is None
    assert [r.ids for r in orc_ids.lookup(spark, path, [8]).collect()] == [dict(expected_ids(2))[8]]
    empty = shared_path(spark, "test-orc")
    orc_ids.write_ids(none, empty)
    assert orc_ids.digest(orc_ids.read_ids(spark, empty)).collect() == []


def test_packing(docs, none):
    rows = packing.pack(packing.pieces(docs, capacity=256), capacity=256).collect()
    want = [(d, k, i, len(x[i : i + 256]), crc(x[i : i + 256])) for d, x in expected_ids(1) for k, i in enumerate(range(0, len(x), 256))]
    assert key(tuple(r)[:5] for r in rows) == key(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) == packing.lower_bound(np.array([r.length for r in rows]), 256)
    assert packing.pack(packing.pieces(none)).collect() == []


def test_packing_over_several_partitions(spark):
    """Every piece once, places gapless, and no more sequences than 1 in 100 over the bound of all pieces."""
    rng = np.random.default_rng(8)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.choice([30, 90, 250, 700, 1300, 1700, 2500, 4096], 6000, p=[0.2, 0.2, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]))]
    df = spark.createDataFrame(rows, packing.PIECES)
    bound = packing.lower_bound(np.array([r[3] for r in rows]), 4096)
    for group_rows in (40_000, 700, 100):
        got = packing.pack(df, group_rows=group_rows).collect()
        assert key(tuple(r)[:5] for r in got) == key(rows)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for x in by.values():
            x.sort()
            assert [a for a, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1]] and sum(n for _, n in x) <= 4096
        assert bound <= len(by) <= bound * 1.01 + 1


def test_lower_bounds_hold():
    mixed = np.array([2500] * 600 + [1700] * 600 + list(range(1, 300)))
    assert packing.lower_bound(mixed, 4096) == 850
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.integers(1, 101, rng.integers(1, 40))
        bins, offsets, free = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= len(free) and (free == 100 - np.bincount(bins, x)).all() and (offsets + x <= 100).all()


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(BASE.split()[20:45])), (2, "two words"), (3, None), (4, "..."), (5, text(9, 40)), (10, " ".join(BASE.split()[30:41])), (2, "two words")]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, check string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = []
    for d, t in DOCS:
        w, hit, which = words(t), set(), set()
        for i, x in items:
            x = words(x)
            k = min(10, len(x))
            for j in range(len(x) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[j : j + k]:
                        hit.update(range(p, p + k))
                        which.add(str(i))
        want.append((d, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    for size in (decontam.BLOCK_BYTES, 60):  # in one block and in several
        got = decontam.digest(decontam.matches(docs, bench, block_bytes=size)).drop("longest").collect()
        assert key(got) == key(want)
    assert decontam.matches(none, bench).collect() == []
    assert {r.contaminated for r in decontam.digest(decontam.matches(docs, bench.where("item_id < 0"))).collect()} == {False}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {d for d, *_, bad in want if not bad}


def test_personal_data(docs, none):
    t = dict(DOCS)[12]
    spans = pii.base_spans(t)
    assert [(k, t[a:b]) for k, a, b in spans] == [("email", "bob@x.org"), ("phone", "+44 20 7946 0958"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")]
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for x in ["a@b.c%d@e.f x@y@z.w .@a-.b", "1@2.3.4", "@x.y", "a@b c@d.e"]:
        assert pii.emails(x) == [m.span() for m in pattern.finditer(x)]
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for x in ["1.2.3.4.5.6.7.8.9", "01.002.0255.4", "256.1.1.1 1.1.1.255", "9" * 5000 + ".1.1.1", "0" * 5000 + "1.1.1.1", "1..2.3.4.5", "12.3.4"]:
        good = [m.span() for m in ip.finditer(x) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        assert [(a, b) for k, a, b in pii.base_spans(x) if k == "ip"] == good
    got = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    assert (got[12].n_email, got[12].n_ip, got[12].n_card, got[12].n_phone) == (1, 1, 1, 1) and got[5].spans == "" and len(got) == 15
    assert got[12].base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
    assert pii.redacted(t, spans) == "mail <EMAIL> or <PHONE>, card <CARD> at <IP>"
    assert pii.find(none, pii.fit(none)).collect() == []


def luhn_card(rng):
    d = "".join(map(str, rng.integers(0, 10, 15)))
    return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))


def test_forms_that_the_base_patterns_miss(spark):
    """Trained on a corpus with base spans only, the trees find other forms, and leave clean numbers alone."""
    rng = np.random.default_rng(11)
    prose = lambda: text(int(rng.integers(1 << 30)), 25)
    email = lambda: f"{rng.choice(WORDS)}.{rng.integers(99)}@mail{rng.integers(9)}.example.{rng.choice(['com', 'org', 'net'])}"
    ip = lambda: ".".join(map(str, rng.integers(1, 256, 4)))
    phone = lambda: f"+{rng.integers(1, 99)} ({rng.integers(100, 999)}) {rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    clean = lambda: [f"on {rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(10**15, 10**16)}", f"1, 2, {rng.integers(99)}, 4", f"{rng.integers(2, 90)} @ {rng.integers(2, 9)}.50 each", "v1.2.3.4.5.6"][int(rng.integers(5))]
    rows = []
    for i in range(600):
        x = [email, ip, phone, lambda: luhn_card(rng), lambda: f'token = "{key()}"', clean][i % 6]()
        rows.append((i, f"{prose()} is {x} {prose()}"))
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    planted = {
        "email": lambda: email().replace("@", " (at) ").replace(".", " (dot) "),
        "ip": lambda: ip().replace(".", "[.]"),
        "phone": lambda: f"{rng.integers(100, 999)} {rng.integers(100, 999)} {rng.integers(1000, 9999)}",
        "card": lambda: ".".join(re.findall("....", luhn_card(rng))),
        "secret": lambda: f"the key is {key()}",
    }
    for kind, form in planted.items():
        caught = 0
        for _ in range(60):
            x = f"{prose()} is {form()} {prose()}"
            assert not pii.base_spans(x)
            caught += any(k == kind for k, _, _ in pii.added_spans(x, [], model))
        assert caught >= 54, (kind, caught, x, [(*c, model.probability(np.array([pii.features(x, *c)]))) for c in pii.candidates(x)], model.thresholds)
    wrong = sum(bool(pii.added_spans(x, pii.base_spans(x), model)) for x in (f"{prose()} is {c}, {prose()}" for c in (clean() for _ in range(200)) if not pii.base_spans(c)))
    assert wrong <= 6
    docs = spark.createDataFrame([(1, f"write to ann (at) mail3 (dot) example (dot) com {prose()}"), (1, None), (None, "")], "doc_id long, text string")
    assert pii.redact(docs, model).where("text LIKE '%<EMAIL>%'").count() == 1 and pii.redact(docs.where("doc_id > 5"), model).count() == 0


def test_recall_of_given_secrets(spark):
    """The strings of 40 hexadecimal digits that the given documents assign to a token: a rare kind, with few rows to set a threshold by."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "spans")
    hit = every = 0
    for r in docs.join(found, "doc_id").where("text RLIKE 'token = \"[0-9a-f]{40}\"'").collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text):
            every += 1
            hit += any(int(a) <= m.start(1) and int(b) >= m.end(1) for _, a, b in spans)
    assert every >= 10 and hit >= 0.9 * every, (hit, every)
    # what is added elsewhere stays rare: fewer spans than one in a hundred documents beyond base and tokens
    base = sum(r.n for r in pii.find(docs, pii.Selector()).selectExpr("n_spans AS n").collect())
    more = sum(r.n for r in pii.find(docs, pii.fit(docs)).selectExpr("n_spans AS n").collect())
    assert 0 <= more - base - hit <= docs.count() / 100, (base, more, hit)


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, pii.FEATURES))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = pii.boost(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in lz.fingerprint_documents(docs.where("doc_id < 14")).collect()}
    texts = {d: t or "" for d, t in DOCS if d and d < 14}
    for d, t in texts.items():
        after = texts[d - 1] if d > 1 else texts[13]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[d].fingerprint == lz.hexed(lz.fingerprints([t])[0]) and got[d].edited_fingerprint == lz.hexed(lz.fingerprints([e])[0])
    # an own parse, phrase by phrase: the number of phrases, equal texts, and likeness from the hexadecimal fingerprints
    def phrases(t):
        words = [w[i : i + lz.UNIT_BYTES] for w in re.findall(rb"[^\x20\x09-\x0D]+", t.translate(LOWER).encode()) for i in range(0, len(w), lz.UNIT_BYTES)]
        found, now = set(), ()
        for w in words:
            now = (*now, w)
            if now not in found:
                found.add(now)
                now = ()
        return found | ({(*now, None)} if now else set())

    def likeness(a, b):
        a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a, b))
        union = sorted(a | b)[: lz.SIZE]
        return len(a & b & set(union)) / len(union) if union else 1.0

    edits = {d: t[: len(t) - len(t) // 2] + (texts[d - 1] if d > 1 else texts[13])[: len(t) // 2] for d, t in texts.items()}
    for d, t in texts.items():
        assert len(got[d].fingerprint) // 8 == min(lz.SIZE, len(phrases(t))) and len(got[d].edited_fingerprint) // 8 == min(lz.SIZE, len(phrases(edits[d])))
        assert got[d].near_edited == pytest.approx(likeness(got[d].fingerprint, got[d].edited_fingerprint)) and got[d].near_next == pytest.approx(likeness(got[d].fingerprint, got[d - 1 if d > 1 else 13].fingerprint))
        for e, u in texts.items():
            assert (got[d].fingerprint == got[e].fingerprint) == (phrases(t) == phrases(u))
            if len(phrases(t) | phrases(u)) <= lz.SIZE and phrases(t) | phrases(u):
                assert likeness(got[d].fingerprint, got[e].fingerprint) == pytest.approx(len(phrases(t) & phrases(u)) / len(phrases(t) | phrases(u)))
    assert len({lz.hexed(f) for f in lz.fingerprints(["x", "x x", "x y", "x y x"])}) == 4
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[4].near_next < 0.5 < got[3].near_next
    assert len(lz.fingerprint_documents(docs).collect()) == len(DOCS) and lz.fingerprint_documents(none).collect() == []


def test_next_documents_over_ranges(spark, monkeypatch):
    """Many ranges, one id and null with a third of the rows each: every document once, the next one as by sorting."""
    monkeypatch.setattr(lz, "RANGE_BYTES", 30_000)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, text(i, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashes[r[1]]))
    want = []
    for (d, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((d, hashlib.sha256(e.encode()).hexdigest()))
    assert key((r.doc_id, r.edited_sha256) for r in lz.fingerprint_documents(df).collect()) == key(want)
    sizes = lz.with_next(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 400


def test_language_id(spark, none):
    rng = np.random.default_rng(2)
    make = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(30))
    rows = [(i, make(["th", "er", "ing"]) if i % 2 else make(["ção", "de", "os"]), "en" if i % 2 else "pt") for i in range(80)]
    rows += [(100, None, "en"), (101, "123 !!", "en"), (102, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 60"))
    got = {r.doc_id: r for r in langid.identify(df, model, "doc_id").collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(60, 80)) and got[102].lang_pred == "pt"
    assert got[100].lang_pred == got[101].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(none, langid.fit(none), "doc_id").collect() == []


def test_temperature():
    """Logits that are k times too large get k back; logits without an error have a finite temperature."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 4)) * 2
    y = (x + rng.gumbel(size=x.shape)).argmax(axis=1)
    for k in (0.2, 1, 30):
        assert langid.temperature(k * x, y) == pytest.approx(k, rel=0.15)
        p = langid.softmax(k * x / langid.temperature(k * x, y)).max(axis=1)
        assert abs(p.mean() - (x.argmax(axis=1) == y).mean()) < 0.02
    assert 0 < langid.temperature(np.eye(3)[[0, 1, 2, 0]], np.array([0, 1, 2, 0])) < 1


def test_ftrl_is_sparse_and_tfidf_counts(spark):
    """Frequencies over all rows, weights that l1 sets to nothing, clashing and repeated columns."""
    rows = [(i, "the other thing" if i % 2 else "os outros dados", "en" if i % 2 else "pt", 0.5) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, score double")
    model = langid.fit(df)
    at, counts = langid.places("the other thing")
    assert set(model.idf[at].round(6)) == {round(math.log(62 / 31) + 1, 6), 1.0} and np.isclose(np.linalg.norm(model.vector(at, counts)), 1)
    assert 0 < (model.weights != 0).any(axis=1).sum() <= len(set(at) | set(langid.places("os outros dados")[0]))
    got = langid.identify(df.drop("score"), model, "doc_id").collect()
    assert len(got) == 61 and all(r.lang_pred == ("en" if r.doc_id % 2 else "pt") for r in got)


def test_warc_round_trip(spark):
    big, other = "x" * 150, "é" * 80
    pages = [(3, "http://a/x y", big), (1, "http://a/2", big), (2, None, "small"), (4, "http://b/", "small"), (5, "http://c", None), (6, "http://d", other + "\r\n\r\nWARC/1.0\r\n"), (None, "http://e", big), (1, "http://a/2", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, file int")
    records = warc.read_warc(warc.convert(warc.write_arc(df, shared_path(spark, "t-arc")), shared_path(spark, "t-warc")), with_payload=True).collect()
    want = []
    for i, _, h in pages:
        p = (h or "").encode()
        to = 1 if h == big and i != 1 else None
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if to else "response", to))
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == key(want)
    assert {bytes(r.payload) for r in records if r.page_id == 6} == {pages[5][2].encode()}
    assert warc.read_warc(warc.convert(warc.write_arc(df.where("page_id < 0"), shared_path(spark, "t-arc")), shared_path(spark, "t-warc"))).collect() == []
    assert warc.iso_date("1999") == "1999-01-01T00:00:00Z" and warc.iso_date("20240102030405") == "2024-01-02T03:04:05Z"


def test_host_text(spark):
    article = "<nav>menu</nav><article><header><h1>T&amp;x</h1></header><p>One <b>two</b><br>three</p><aside>no</aside><div class='comments'><p>c</p></div><form>f</form></article><footer>end</footer>"
    shared = "<div>one two three four five six seven eight nine ten</div>"
    pages = [(1, "http://a/1", article), (2, "http://b/1", shared + "<p>alpha beta</p>"), (3, "http://b/2", shared + "<p>gamma</p>"), (4, "http://c/1", shared + "<p>delta</p>"), (5, None, None), (6, "http://a", ""), (7, "http://a", "<p>a &lt; b</p><script>var x='</p>'</script><div class=\"ad\">buy</div>")]
    df = spark.createDataFrame([(*p, "k", "h") for p in pages], "page_id long, url string, html string, k string, host string")
    got = {r.page_id: r.text for r in host_text.extract(df).collect()}
    assert got == {1: "T&x\nOne two three", 2: "alpha beta", 3: "gamma", 4: "one two three four five six seven eight nine ten\ndelta", 5: "", 6: "", 7: "a < b"}
    assert host_text.extract(df.where("page_id < 0")).collect() == []


def test_tags_are_read_as_browsers_do():
    page = """<body><p title=it's>hello <a href=/x/y'z>link</a></p><p title="a>b" data-x='c"d'>quoted</p><p = x>sign</p><img src=a.png/><br/>x &amp; y</body>"""
    assert host_text.blocks(page) == ([("open", "hello link"), ("open", "quoted"), ("open", "sign"), ("open", "x & y")], False)
    page = "<div class='page-header-wrap'><article><div class='content search-result'>kept</div><ul class='menu-of-the-day'><li>soup</li></ul><div class='share'>gone</div></article></div>"
    assert [t for w, t in host_text.blocks(page)[0] if w == "article"] == ["kept", "soup"]


def expected_text(pages):
    """Of pages without an article, from whole hosts: words that no repeated run of RUN words covers."""
    n, found = host_text.RUN, {}
    split = {i: (host_text.host_of(u), [(w, t.split()) for w, t in host_text.blocks(h or "")[0]]) for i, u, h in pages}
    html_of = {i: h for i, _, h in pages}
    for i, (host, blocks) in split.items():
        stream = [x for _, t in blocks for x in t]
        covered = set()
        for p in range(len(stream) - n + 1):
            run = stream[p : p + n]
            for j, (other, theirs) in split.items():
                s = [x for _, t in theirs for x in t]
                if other == host and html_of[j] != html_of[i] and any(s[q : q + n] == run for q in range(len(s) - n + 1)):
                    covered.update(range(p, p + n))
        at, out = 0, []
        for w, t in blocks:
            if w == "open":
                out.append(" ".join(x for k, x in enumerate(t) if at + k not in covered))
            at += len(t)
        found[i] = "\n".join(x for x in out if x)
    return found


@pytest.mark.parametrize("parts", [1, 7])
def test_host_text_of_pages_without_articles(spark, parts):
    """Against brute force, however rows are dealt: menus of short blocks, repeated rows, copies, unique words beside boilerplate."""
    rng = np.random.default_rng(4)
    pages = []
    for i in range(30):
        host = f"h{i % 3}"
        menu = "".join(f"<div>{host} {w}</div>" for w in WORDS[:12])
        body = "".join(f"<p>{text(int(rng.integers(1 << 30)), int(rng.integers(1, 30)))}</p>" for _ in range(3))
        mixed = f"<p>{text(int(rng.integers(4)), 12)} unique{i} words</p>"
        pages.append((i, f"http://{host}/{i}", menu + body + mixed + ("<p>all rights are reserved by the owners of this site</p>" if i % 2 else "")))
    pages += [(30, "http://h0/copy", pages[0][2]), (31, "http://h9/x", pages[1][2])]
    df = spark.createDataFrame([*pages, pages[0], pages[5]], "page_id long, url string, html string").repartition(parts)
    got = host_text.extract(df).collect()
    assert len(got) == 34 and {r.page_id: r.text for r in got} == expected_text(pages)
    assert "unique5" in expected_text(pages)[5] and "unique6 words" in expected_text(pages)[6] and "h2 w0" not in expected_text(pages)[5]


def test_suffix_groups():
    t = np.array([5, 6, 7, 5, 6, 8, 5, 6, 7], np.uint64)
    order, groups = host_text.suffix_groups(t, 3)
    assert len({g for o, g in zip(order, groups, strict=True) if o in (0, 6)}) == 1 and groups[list(order).index(7)] == -1


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best_fit_packing"
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < rows.select("doc_id").distinct().count() < n


def test_hosts_decide_beside_articles(spark):
    """On pages with an article too, unmarked text goes where the host repeats it and stays where it doesn't."""
    again = "every page of this host says these same ten words"
    html = [f"<body><div>{again}</div><div>{i} begins alone here</div><article><p>Story {i}.</p><p>{again}</p></article><nav>home</nav><div>its end {i} {again}</div></body>" for i in range(3)]
    rows = spark.createDataFrame([(i, "http://a.org/x", h) for i, h in enumerate(html)] + [(9, "http://b.org/", html[0])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in host_text.extract(rows).collect()}
    assert all(got[i] == f"{i} begins alone here\nStory {i}.\n{again}\nits end {i}" for i in range(3))
    assert got[9] == f"{again}\n0 begins alone here\nStory 0.\n{again}\nits end 0 {again}"
