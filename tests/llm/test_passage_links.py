"""Passages that share a frequent line with more documents than are linked at once."""

import numpy as np
import pyarrow as pa
import pytest

from terrane.llm import passages


@pytest.mark.parametrize("edit", [None, 9])
def test_repeats_around_frequent_lines(spark, edit):
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    lines, side, n, others = [words(38) for _ in range(12)], 6 if edit is None else 16, 96, 80
    texts = [sum((words(30) + line for line in lines), []) for _ in range(others)]
    whole = [words(side) + lines[k % 12] + words(side) for k in range(n)]
    for copy in range(2):
        for x in whole:
            x = list(x)
            if copy and edit is not None:
                x[edit] = "edited"
            texts.append(words(30) + x + words(30))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    marked = {}
    for r in passages.repeated_passages(df).collect():
        assert r.source_id < r.doc_id
        marked.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    for doc in range(others + n, others + 2 * n):
        assert set(range(30 + (0 if edit is None else edit + 1), 30 + len(whole[0]))) <= marked.get(doc, set())


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_links_are_all_pairs_of_up_to_KINDS(size):
    rng = np.random.default_rng(size)
    rows = [(k, int(near), int(doc)) for k, n, many in ((1, 5, 3), (2, 200, passages.KINDS), (3, 300, 200), (5, 1, 9)) for near, doc in zip(rng.integers(0, many, n), rng.integers(0, 50, n), strict=True)]
    rows = [(k, near, doc, i) for i, (k, near, doc) in enumerate(sorted(rows))]
    names = ["key", "near", "doc", "at", "source", "sat"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*r, r[2], r[3]) for r in rows[i : i + size]), strict=True), kinds, strict=True)], names) for i in range(0, len(rows), size)]
    got = [r for b in passages._links(iter(batches)) for r in zip(*(b.column(n).to_pylist() for n in ("doc", "source", "at", "sat")), strict=True)]
    stands, want, again = {}, set(), set()
    for k, near, doc, at in rows:
        first = stands.setdefault((k, near), (doc, at))
        if first[0] < doc:
            want.add((doc, first[0], at, first[1]))
    for k in (1, 2, 3, 5):
        mine = [x for (key, _), x in stands.items() if key == k]
        if len(mine) > passages.KINDS:
            again |= {(doc, doc, at, k) for doc, at in mine}
        else:
            want |= {(d, s, a, b) for d, a in mine for s, b in mine if s < d}
    assert len(got) == len(set(got)) and set(got) == want | again


def _variants(rng, n, words=56, edits=1):
    """Texts of random words around one passage, in each of which some words are others (or gone, or doubled)."""
    whole, texts = [f"p{k}" for k in range(words)], []
    for k in range(n):
        x = list(whole)
        for at in rng.integers(0, words, edits).tolist():
            x[at] = rng.choice([f"e{k}", "", f"{x[at]} e{k}"])
        texts.append(" ".join([*(f"a{k}x{i}" for i in range(40)), *x, *(f"b{k}x{i}" for i in range(40))]))
    return texts


def _tokens(text):
    return passages.Words([text.encode()]).shingles(passages.SHINGLE)[0].astype(np.uint32).astype(np.int64)


@pytest.mark.parametrize("n", [150, 300])
def test_variants_of_a_frequent_passage_lose_no_partner(spark, n):
    texts = _variants(np.random.default_rng(n), n, edits=2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tokens, cover, group = [_tokens(t) for t in texts], [set() for _ in texts], list(range(n))
    signs = []  # of each text's windows: texts that share none aren't candidates
    for text in texts:
        t, wall, *_ = next(passages._laid([text.encode()]))
        signs.append({k for key, *_ in passages.signatures(t, wall) for k in key.tolist()})
    for i in range(n):
        for j in (j for j in range(i) if signs[i] & signs[j]):
            for first, last in passages.verify(tokens[i], tokens[j]):
                cover[i] |= set(range(first, last + passages.SHINGLE))
                group = [group[j] if g == group[i] else g for g in group]
    got, joined, rows = [set() for _ in texts], list(range(n)), passages.repeated_passages(df).collect()
    for r in rows:
        assert r.source_id < r.doc_id
        got[r.doc_id] |= set(range(r.first_word, r.end_word))
        joined = [joined[r.source_id] if g == joined[r.doc_id] else g for g in joined]
    assert [i for i in range(n) if bool(got[i]) != bool(cover[i])] == []
    assert sum(len(c - g) for c, g in zip(cover, got, strict=True)) <= 0.01 * sum(map(len, cover))
    assert len({(a, b) for a, b in zip(group, joined, strict=True)}) == len(set(group)) == len(set(joined))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_related_windows_are_covered_and_connected(edits):
    rng, n, run = np.random.default_rng(edits), 120, np.arange(10_000, 10_000 + passages.BESIDE)
    side = passages.LEAST - 1
    whole = np.concatenate([np.arange(side), run, np.arange(100, 100 + side)])
    rows = np.repeat(whole[None], n, 0)
    for k in range(n):
        for at in rng.integers(0, side - 6, edits).tolist():
            rows[k, at + (side + passages.BESIDE if rng.integers(2) else 0) :][:5] = 20_000 + 1000 * k + at + np.arange(5)
        rows[k, : rng.integers(0, 30)] = -1
    doc = np.sort(rng.integers(0, 80, n))
    links = passages.related(doc, rows)
    assert all(doc[i] > doc[j] for i, j in links) and len(links) < 8 * n

    def runs(i, j):
        here, there = (r[r >= 0] for r in (rows[i], rows[j]))
        skip = passages._AROUND - here.size
        return {p for a, b in passages.verify(here, there) for p in range(a, b + 1) if a + skip <= side and b + skip >= side + passages.BESIDE - 1}

    group, joined = list(range(n)), list(range(n))
    for i in range(n):
        want, have = set(), set().union(*(runs(i, j) for x, j in links if x == i))
        for j in range(i):
            if doc[j] < doc[i] and (found := runs(i, j)):
                want |= found
                group = [group[j] if g == group[i] else g for g in group]
        assert want <= have
    for i, j in links:
        joined = [joined[j] if g == joined[i] else g for g in joined]
    assert len({(a, b) for a, b in zip(group, joined, strict=True)}) == len(set(group)) == len(set(joined))


def test_links_of_a_frequent_passage_grow_with_its_windows():
    counts = []
    for n in (200, 400):
        tokens = [_tokens(t) for t in _variants(np.random.default_rng(1), n, 70)]
        run = _tokens(" ".join(f"p{k}" for k in range(70)))[25 : 25 + passages.BESIDE]
        places = [int(np.flatnonzero(np.isin(t, run))[0]) for t in tokens]
        rows = np.stack([np.pad(t, passages.LEAST, constant_values=-1)[p + 1 :][: passages._AROUND] for t, p in zip(tokens, places, strict=True)])
        counts.append(len(passages.related(np.arange(n), rows)))
    assert 0 < counts[0] and counts[1] < 3 * counts[0]


def test_signatures_at_once_are_as_one_by_one_and_seldom_verified_apart(monkeypatch):
    rng, side, calls, verify = np.random.default_rng(5), passages.LEAST - 1, [], passages.verify
    rows = []
    for _ in range(3):
        whole = rng.integers(0, 1 << 32, passages._AROUND)
        rows.append(np.repeat(whole[None], 40, 0))
        for k in range(40):
            cut = rng.integers(0, side - 8)
            rows[-1][k, : cut + 1] = np.append(rows[-1][k, 1 : cut + 1], rng.integers(0, 1 << 32))  # one token gone, one before
    rows.append(np.repeat(np.repeat(rng.integers(0, 1 << 32, 1), passages._AROUND)[None], 40, 0))  # one token over and over
    for k in range(40):
        rows[-1][k, : k % 9] = rng.integers(0, 1 << 32, k % 9)
    monkeypatch.setattr(passages, "verify", lambda *a: calls.append(0) or verify(*a))
    doc, sign = np.tile(np.arange(40), 4), np.repeat(np.arange(4), 40)
    links = passages.related(doc, np.concatenate(rows), sign)
    assert len(calls) < 16
    apart = [(i + 40 * k, j + 40 * k) for k in range(4) for i, j in passages.related(np.arange(40), rows[k])]
    assert set(links) == set(apart) and {i for i, _ in links} == {i for i in range(160) if i % 40}


def _over_and_over(rng, n, words=("la", "na"), most=90):
    """Texts in which one word comes over and over, with random words around it; of some, the words before or after come twice."""
    texts, around = [], [[f"s{rng.integers(10**6)}" for _ in range(40)] for _ in range(n)]
    for k in range(n):
        x, y = around[k if k % 3 else max(k - 7, 0)], around[k if k % 5 else max(k - 9, 0)]
        texts.append(" ".join([*x, *[words[k % len(words)]] * int(rng.integers(20, most)), *y]))
    return texts


def test_one_token_over_and_over_has_a_window_at_each_end():
    rng = np.random.default_rng(2)
    for text in (" ".join(["la"] * 300), " ".join(["la"] * 70 + [f"w{k}" for k in range(90)]), *_over_and_over(rng, 20)):
        t, wall, begin, *_ = next(passages._laid([text.encode()]))
        same = [r for r in np.split(np.arange(t.size), np.flatnonzero(np.diff(t)) + 1) if r.size >= passages.BESIDE and not wall[r[0]]]
        for key, _, c, before, after, _ in passages.signatures(t, wall):
            for r in same:
                inner = c[(c > r[0]) & (c <= r[-1] - passages.BESIDE + 1)]
                assert set(inner.tolist()) <= {int(r[-1]) - passages.BESIDE + 1}
            assert len(set(zip(key.tolist(), c.tolist(), strict=True))) == key.size
            assert (c - before > 0).all() and (c + after < t.size - 1).all() and max(before.max(initial=0), after.max(initial=0)) <= passages.REACH


def test_long_run_of_one_token_over_stretches(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join([*(f"a{rng.integers(10**6)}" for _ in range(50)), *["la"] * n, *(f"b{rng.integers(10**6)}" for _ in range(50))]) for n in (9000, 5200)]
    for stretch in (passages.STRETCH, 1000):
        monkeypatch.setattr(passages, "STRETCH", stretch)
        passages._powers.cache_clear()
        for text in texts:
            t, wall, *_ = next(passages._laid([text.encode()]))
            run = np.flatnonzero(t == t[t.size // 2])
            found = [(c, b, a) for _, _, c, b, a, _ in passages.signatures(t, wall)]
            at, before, after = (np.concatenate(x) for x in zip(*found, strict=True))
            assert {int(run[0]), int(run[-1]) - passages.BESIDE + 1} == set(at[np.isin(at, run[: 1 - passages.BESIDE])].tolist())
            assert before.max() <= passages.REACH and after.max() <= passages.REACH
    passages._powers.cache_clear()


@pytest.mark.parametrize("n", [9, 60])
def test_repeats_of_one_token_over_and_over_lose_no_partner(spark, n):
    texts = _over_and_over(np.random.default_rng(n), n)
    tokens, cover = [_tokens(t) for t in texts], [set() for _ in texts]
    for i in range(n):
        for j in range(i):
            for first, last in passages.verify(tokens[i], tokens[j]):
                cover[i] |= set(range(first, last + passages.SHINGLE))
    got = [set() for _ in texts]
    for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id] |= set(range(r.first_word, r.end_word))
    assert sum(map(len, cover)) and [i for i in range(n) if bool(cover[i]) != bool(got[i])] == []
    assert sum(len(c - g) for c, g in zip(cover, got, strict=True)) <= 0.01 * sum(map(len, cover))


def test_frequent_token_over_and_over_is_not_compared_in_the_square(monkeypatch):
    rng, pairs, one = np.random.default_rng(7), [], passages._pairwise
    monkeypatch.setattr(passages, "_pairwise", lambda i, *a: pairs.append(len(i)) or one(i, *a))
    counts = []
    for n in (1600, 6400):
        rows = rng.integers(1, 1 << 32, (n, passages._AROUND))
        for r, a, b in zip(rows, rng.integers(0, passages.LEAST, n), rng.integers(passages.LEAST, passages.BESIDE + 2 * passages.LEAST - 1, n), strict=True):
            r[a : max(b, passages.LEAST - 1 + passages.BESIDE)] = 0
        pairs.clear()
        assert len(passages.related(np.arange(n), rows)) >= n // 4
        counts.append(sum(pairs))
    assert counts[1] < 6 * counts[0]


def test_verified_together_as_one_by_one():
    rng = np.random.default_rng(3)
    mine, other = [], []
    for k in range(600):
        tokens = np.unique(rng.integers(-(1 << 31), 1 << 20, 260))
        rng.shuffle(tokens)
        n = int(rng.integers(0, 200))
        x, y = tokens[:n].copy(), list(tokens[int(rng.integers(0, 20)) : n + int(rng.integers(0, 40))])
        for _ in range(int(rng.integers(0, 8))):
            at, w = int(rng.integers(0, len(y) + 1)), int(rng.integers(1, 30))
            y[at : at + (0 if k % 3 else w)] = [] if k % 3 == 1 else rng.integers(1 << 21, 1 << 22, w).tolist()
        if k % 11 == 0:
            x[n // 4 : n // 2] = 5
        mine.append(x)
        other.append(np.array(y[::-1] if k % 13 == 0 else y, np.int64))
    want = [passages.verify(a, b) for a, b in zip(mine, other, strict=True)]
    assert passages.verify_all(mine, other) == want and sum(map(len, want)) > 100
    assert passages.verify_all(mine[:1], [np.zeros(0, np.int64)]) == [[]] and passages.verify_all([], []) == []


def test_wanting_window_without_a_partner_left_to_try():
    rng, n, side = np.random.default_rng(1), 400, passages.LEAST - 1
    rows = rng.integers(1, 1 << 32, (n, passages._AROUND))
    rows[2:-1] = rows[2]
    rows[2:-1, 4:44:4] = rng.integers(1, 3, (n - 3, 10)) << 33 | np.arange(10)  # 1,024 ways
    rows[1, :30], rows[-1] = rows[0, :30], rows[-2]
    rows[-1, -16:] = np.where(np.arange(16) % 2, rows[0, -16:], rows[1, -16:])  # which it has with the first few alone
    rows[:, side : side + passages.BESIDE] = np.arange(1 << 40, (1 << 40) + passages.BESIDE)
    links = passages.related(np.arange(n), rows)
    assert {i for i, _ in links} == set(range(3, n))
