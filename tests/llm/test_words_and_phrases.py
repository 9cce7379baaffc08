"""Spelling variants, token counts and collocations on small tables against brute force, and on empty tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from loomgraph.llm import collocations, lz, packing, spelling, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, path string, lengths int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, x, "s", 0, "w", 1, "p", 2) for d, t, x in rows], COLUMNS)


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants_by_hand(rows):
    counts = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(others), best if best and words[best] >= 10 * n else None)
    got = set()
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        got.add((w, n, k, form, words[form] if form else None, root))
    return got


def test_spelling_variants(spark):
    rng = np.random.default_rng(3)
    letters = list("abeén")
    bases = ["".join(rng.choice(letters, rng.integers(7, 12))) for _ in range(30)] + ["aaaaaaa", "bbbbbbbb", "Pumpenhaus", "kreiselpumpe"]
    rows = []
    for i in range(900):
        w = bases[int(rng.integers(len(bases)) * rng.random())]
        for _ in range(rng.integers(0, 3) if rng.random() < 0.4 else 0):
            at, kind = int(rng.integers(len(w))), rng.integers(3)
            w = w[:at] + (str(rng.choice(letters)) if kind else "") + w[at + (kind != 1) :]
        rows.append((None if i % 50 == 0 else i % 400, " ".join([w, w.upper() if i % 7 == 0 else w, "short"]), "en"))
    rows += [(1, None, "en"), (2, "", "en"), (3, "kreiselpumpe-kreiselpumpe_kreiselpumpe", None), (3, "kreiselpumpe-kreiselpumpe_kreiselpumpe", None), (4, "z" * 5000 + " " + "z" * 5000 + "  " + "z" * 4999, "en"), (5, "z" * 4999, "en")]
    rows += [(500, "qrstuvab " * 2 + "qrstuvac " * 30 + "qrstuvbc " * 400, "en")]  # a chain of two forms
    got = spelling.variants(spelling.counted_words(frame(spark, rows))).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = variants_by_hand(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(1 for x in want if x[2]) > 100 and sum(1 for x in want if x[3]) > 10 and any(x[3] and x[5] != x[3] for x in want)
    assert spelling.variants(spelling.counted_words(frame(spark, []))).collect() == []


def test_pivots_are_disjoint_and_light(spark):
    grams = [(9, "aa", 1), (1, "ab", 2), (5, "bc", 3), (1, "cd", 4)]
    df = spark.createDataFrame([(grams,)], "p array<struct<weight: long, gram: string, at: int>>")
    assert [[g.at for g in r] for r in df.select(spelling.pivots(spelling.F.col("p"), 2), spelling.pivots(spelling.F.col("p"), 1)).first()] == [[2, 4], [2]]


TEXTS = [None, "", " ", "Hello  world\n\n it's 'tis  we'll\t'd x's  ", "a<|endoftext|> b<|endoftext|>", "²½ 12ab ÀÉñ 世界 😀😀 \x85\xa0 \x1c​", "word " * 3000, "x" * 5000, "'s" * 50, " 's!'s\n's", "the the the"]


def test_token_counts(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path(token_counts.DEFAULT)
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    alphabet = [*"ab'stTrevlmd  \n\t!.1²ÀÉ\x85\xa0\x1c世😀’_", "'re", "'ll", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]
    rows = [(None if i == 3 else i % 1000, t, "en") for i, t in enumerate(texts)]
    want = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, _ in rows), key=repr)
    assert sorted(map(tuple, token_counts.count_tokens(frame(spark, rows)).collect()), key=repr) == want
    monkeypatch.setattr(token_counts, "BATCH", 40)  # slices of long texts
    cut = token_counts.PreTokens(path)
    few = token_counts.Lengths(*(np.zeros(0, k) for k in (np.uint64, np.uint32, np.uint16)))
    assert cut.count_all(texts, few).tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(frame(spark, [])).collect() == []


def test_tables_of_lengths_and_summaries():
    rng = np.random.default_rng(6)
    keys, seconds = rng.integers(1, 1 << 63, 500).astype(np.uint64), rng.integers(0, 1 << 31, 500).astype(np.uint32)
    keys[100:200] = keys[100:200] >> np.uint64(40) << np.uint64(40)  # all of these begin at the same place
    table = token_counts.Lengths(keys[:400], seconds[:400], np.arange(1, 401).astype(np.uint16))
    assert table.find(keys, seconds).tolist() == [*range(1, 401), *[0] * 100] and not table.find(keys, seconds + np.uint32(1)).any()
    stream = [f"p{int(x)}" for x in rng.zipf(1.3, 20_000)]
    kept = Counter()
    for i in range(0, len(stream), 500):
        kept = token_counts.trimmed(kept + Counter(stream[i : i + 500]), 50)
    true = Counter(stream)
    assert len(kept) <= 50 and all(k in kept for k, n in true.items() if n > len(stream) / 50) and all(n <= true[k] for k, n in kept.items())


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies(spark, name):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, [(1, "Hello world, it's me", "en"), (2, None, "en")]), name).collect()}
    whole = token_counts.Whole(token_counts.vocabulary_path(name))
    assert got == {1: whole.one("Hello world, it's me"), 2: 0} and got[1] > 3


def by_hand(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        mine = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, x, y = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), x, y))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(12)] + ["é", "Z", "a-b"]
    texts = [" ".join(words[int(len(words) * x * x)] + (rng.choice([".", ",", "\n", "", "", "", "", "", "\t"])) for x in rng.random(40)) for _ in range(120)]
    texts += ["Every pump has a seal", "every pump has a seal;  every pump has a seal"] * 12 + [None, "", " .. ", "x x x x x x x x"] + ["x x x x x"] * 5
    rows = [(i % 90, t, [None, "en", "fr", "und"][i % 4]) for i, t in enumerate(texts)]
    for least, top in ((8, 2000), (5, 7)):
        want = by_hand(rows, least, top)
        assert len(want) > 20
        assert sorted(map(tuple, collocations.collocations(frame(spark, rows), least, top).collect())) == want
    monkeypatch.setattr(collocations, "SLICE", 60)  # every text in slices
    parts = [(p, n) for t in texts if t for p, n in collocations.slices(t.encode())]
    assert len(parts) > 1.5 * len(texts) and any(n for _, n in parts)
    known = np.full(64, ~np.uint64(0))
    whole = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            whole["pairs"] += max(0, len(w) - 1)
            whole["long"] += sum(max(0, len(w) - k + 1) for k in (3, 4, 5))
    held = [collocations.Words(*map(list, zip(*[(p, "en", n) for p, n in collocations.slices(t.encode())], strict=True))) for t in texts if t]
    assert sum(len(collocations.phrases_of(w, known)) for w in held) == whole["pairs"]
    assert sum(len(collocations.phrases_of(w, known, known)) + len(collocations.phrases_of(w, known, known, known)) for w in held) == whole["long"]
    assert collocations.collocations(frame(spark, [])).collect() == [] and collocations.collocations(frame(spark, rows), 10_000).collect() == []


def test_trie_bursts_and_gives_sorted_runs():
    rng = np.random.default_rng(8)
    trie, want, runs = collocations.HatTrie(4, burst=20), Counter(), []
    for _ in range(200):
        rows = np.minimum(rng.zipf(1.5, (60, 4)), 9).astype(np.uint64)
        want.update(map(tuple, rows.tolist()))
        trie.add(*collocations.gathered(rows))
        if trie.size() > 1500:
            runs.append(list(trie.taken(trie.largest(700))))
    assert any(isinstance(x, collocations.HatTrie) for x in trie.children.values()) and len(runs) > 1
    runs.append(list(trie.taken()))
    assert not trie.children
    got = Counter()
    for run in runs:
        rows = [tuple(r) for part, _ in run for r in part.tolist()]
        assert rows == sorted(set(rows))
        for part, counts in run:
            for r, n in zip(part.tolist(), counts.tolist(), strict=True):
                got[tuple(r)] += n
    assert got == want


def test_small_tries_change_nothing(spark):
    rows = [(i, (" ".join(f"v{(i * j) % 17}" for j in range(60)) + " ") * 600, "en") for i in range(80)]
    docs = frame(spark, rows).select("lang", "text").coalesce(2)
    everything = np.full(64, ~np.uint64(0))
    few = collocations.counted_in_tries(docs, everything, budget=50)
    many = collocations.counted_in_tries(docs, everything)
    total = lambda runs: pd.DataFrame(runs.groupBy("w1", "w2").sum("n").toPandas()).sort_values(["w1", "w2"]).to_numpy().tolist()
    assert few.count() > many.count() and total(few) == total(many) and sum(r[2] for r in total(few)) == 80 * (60 * 600 - 1)


def test_equal_pieces_are_spread(spark):
    """4,000 equal rows in groups of 500: no group has much more, so no partition packs them all."""
    rows = [(7, 0, 0, 100, 1)] * 4000 + [(i, 0, 0, 50 + i % 40, i) for i in range(1000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), capacity=1000, group_rows=500, rounds=0).toPandas()
    assert len(got) == 5000 and got.groupby("sequence_id")["length"].sum().max() <= 1000
    assert (got["sequence_id"].to_numpy() >> 24 & 0xFFFF).tolist() and got.groupby(got["sequence_id"] // (1 << 24)).size().max() < 700


def test_language_stage_without_labels(spark):
    """Where no row has a lang nothing was learnt, so no document goes; repeated rows and nulls stay as they are."""
    import corpus_pipeline

    rows = [(1, "a text", None, "s", 6, 0), (1, "a text", None, "s", 6, 0), (2, None, None, None, None, 0), (3, "", None, "s", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    got = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[:5] for r in rows), key=repr)
    assert corpus_pipeline.language_id(spark, docs.where("false"), "").collect() == []


def test_long_documents_are_parsed_few_at_a_time():
    rows = [(0, i, "x" * (lz.BATCH_CHARS // 4)) for i in range(100)] + [(0, 100 + i, "y") for i in range(1000)] + [(0, 1100 + i, "z" * lz.BATCH_CHARS) for i in range(3)]
    lists = list(lz.batched(rows))
    assert all(len(x) <= lz.BATCH_ROWS + 1 and (len(x) == 2 or sum(len(t) for *_, t in x[:-1]) < lz.BATCH_CHARS) for x in lists)
    assert [r for x in lists for r in x[:-1]] + [lists[-1][-1]] == rows
    assert all(a[-1] == b[0] for a, b in zip(lists, lists[1:]))
