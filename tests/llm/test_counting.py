"""Decontamination, collocations and spelling variants against brute force, with nulls, ties, repeats, long texts and odd columns."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import collocations, queries, spelling, suffixes

SF = "/root/testdata/sf0.001"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert _rows(got.select(*cols)) == sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=repr)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for most in (1, 2, 5, 4000):
        ids = rng.integers(0, most + 1, 400)
        ids[100:160] = ids[200:260] = ids[20:80]
        ids[-1] = 0
        runs = {i: tuple(ids[i : i + int(np.argmin(ids[i:] != 0))].tolist()) for i in np.flatnonzero(ids).tolist()}
        assert suffixes.suffix_array(ids).tolist() == sorted(runs, key=lambda i: (runs[i], i))


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))


def _leaks(text, items, window):
    words, hit, found = _words(text), set(), set()
    for name, item in items:
        of = _words(item)
        n = min(window, len(of))
        wanted = {tuple(of[k : k + n]) for k in range(len(of) - n + 1)} if n else ()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in wanted:
                hit |= set(range(k, k + n))
                found.add("" if name is None else str(name))
    return len(words), hit, sorted(found)


ITEMS = [(1, "The quick brown fox, jumps over the lazy dog"), (2, "lazy dog"), (10, ""), (3, None), (None, "ÄrA 42 x"), (4, "a b a b a b a b a b a b"), (4, "c c c c"), (5, "the quick brown fox jumps over the lazy dog")]
TEXTS = [None, "", "...", "the QUICK brown fox jumps over the lazy dog the quick brown fox jumps over the lazy dog", "lazy\x00dog lazy-dog lazydog", "a b " * 40, "xx Ära 42 x Ära 42 xy", "c " * 30000, "q", "brown fox jumps over the zzz lazy dog"]


@pytest.mark.parametrize("block", [suffixes.BLOCK, 200])
def test_contamination(spark, block, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 30)  # items are cut as well
    docs = spark.createDataFrame([*((i, t, "x", "y") for i, t in enumerate(TEXTS)), (None, "lazy dog", "x", "y"), (3, "lazy dog", "x", "y"), (3, "lazy dog", "x", "y")], "doc_id long, text string, spans string, n_words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(((r.doc_id, *_leaks(r.text, ITEMS, 4)) for r in docs.collect()), key=repr)
    got = [(r.doc_id, r.n_words, {k for s in r.spans for k in range(s.start, s.end)}, r["items"]) for r in suffixes.contamination(docs, items, window=4, block=block).collect()]
    assert sorted(got, key=repr) == want
    kept = suffixes.remove_contaminated(docs, items, window=4, block=block)
    assert kept.columns == docs.columns
    assert _rows(kept) == sorted((tuple(r) for r in docs.collect() if not _leaks(r.text, ITEMS, 4)[2]), key=repr)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert _rows(suffixes.contamination(docs, items)) == [(1, 2, [], [])]
    assert _rows(suffixes.contamination(docs.where("false"), items)) == []
    assert _rows(suffixes.longest_matches(docs, items)) == []


def test_longest_matches(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 200, 30)]
    items = [(str(k), " ".join(rng.choice(list("abc"), 30))) for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {}
    for name, item in items:
        of = item.split()
        for p in range(len(of)):
            best = max((n, -d, -at) for d, t in enumerate(texts) for at in range(len(t.split()) + 1) for n in [next((k for k in range(len(of) - p) if t.split()[at + k : at + k + 1] != of[p + k : p + k + 1]), len(of) - p)]) if texts else ()
            if best[0] >= 5:
                want[name, p] = (best[0], -best[1], -best[2])
    got = {(r.item, r.position): (r.length, r.doc_id, r["at"]) for r in suffixes.longest_matches(docs, spark.createDataFrame(items, "item_id string, text string"), least=5).collect()}
    assert got == want


def _phrases(rows, most, least, share, top):
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    n, out = Counter(), defaultdict(list)
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    wanted = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, p), a in wanted.items():
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = (c for (other, q), c in wanted.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if not any(100 * c >= share * a for c in inside):
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(((lang, k, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for k, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)), key=repr)


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations(spark, most):
    rng = np.random.default_rng(most)
    parts = ["New", "york", " City", "\t", "  ", ".", "\n", "é", "中文", "\x1c", "the ", "a b c d ", "a b c d;", "\xa0", "A B x "]
    rows = [("".join(rng.choice([p + " " if rng.random() < 0.7 else p for p in parts], 40)), ["en", None, "de"][int(rng.integers(3))]) for _ in range(60)]
    rows += [(None, "en"), ("", None), rows[0], rows[0], ("a b c d " * 3000, "en")]
    docs = spark.createDataFrame([(t, lang, 1, "w") for t, lang in rows], "text string, lang string, n long, piece string").repartition(5)
    got = collocations.collocations(docs, most=most, least=4, share=60, top=25)
    assert _rows(got) == _phrases(rows, most, 4, 60, 25)
    assert _rows(collocations.collocations(docs.where("false"))) == []


def test_scores_past_64_bits(spark):
    big = 10**14
    counted = spark.createDataFrame([("en", "", 3 * big), ("en", "x", big + 7), ("en", "y", big + 1), ("en", "x y", big)], "lang string, phrase string, f long")
    assert _rows(collocations.scored(counted)) == [("en", "x y", big, big + 7, big + 1, 3 * big, 1000000 * big * big // ((big + 7) * (big + 1)))]


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", _lower(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: sorted((-n[v], v) for v in n if _near(w, v)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n[w] else None for w in n}
    root = lambda w: root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def test_variants(spark):
    rng = np.random.default_rng(4)
    stems = ["planet", "plannet", "planett", "planets", "plaet", "aaaaa", "aaaaaa", "aaaa", "ÉcoleÀ", "écolé", "écolÀ", "x×y÷zz", "Wörter"]
    made = [s[:i] + c + s[i + k :] for s in stems for i in range(len(s)) for c in ("", "a", "é", "aa") for k in (0, 1)]
    pool = rng.permutation(made + stems * 8)
    rows = [(None if d % 17 == 0 else d, " ".join(rng.choice(pool, 60, p=None)) + rng.choice([".", "中", "1", "\n"])) for d in range(150)]
    rows += [(7, None), (8, ""), rows[3], rows[3], (9, "planet " * 5000 + "q" * 100_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n long").repartition(4)
    assert _rows(spelling.variants(docs)) == _variants(rows)
    assert _rows(spelling.variants(docs.where("false"))) == []


def test_no_deletions(spark):
    docs = spark.createDataFrame([(i, "Straße straße") for i in range(97)], "doc_id long, text string")
    assert _rows(spelling.words(docs, every=None)) == [("straße", 194)]


def test_roots_follow_long_chains(spark):
    formed = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 37 else None) for i in range(38)], "word string, form string")
    assert {r.root for r in spelling.rooted(formed).where(F.col("word") != "w37").collect()} == {"w37"}
