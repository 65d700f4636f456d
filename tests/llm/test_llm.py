"""Operators against brute force, on small fixtures with nulls, empty texts, ties and long texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from terrane.llm import bpe, huffman, media, mixing, packing, passages, quality, secrets, simhash, unigram

WORD = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello  World", "Hello  World", "<|endoftext|> it's 12 \u4e2d\u6587 \U0001f600", "a" * 3000, "token=token: token=xyzabc AKIA" + "A" * 20, " ".join(f"w{i}" for i in range(900))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_bpe(docs):
    t = Tokenizer.from_file(WORD)
    for r in bpe.encode(docs, WORD).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.text) == (ids, t.decode(ids, skip_special_tokens=False))


def test_decode_joins_pieces(spark):
    t, rows = Tokenizer.from_file(WORD), [(0, [320, 49407, 1125]), (1, []), (2, None), (3, [320, 320])]
    got = dict(bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), WORD, "k").collect())
    assert got == {k: t.decode(ids or [], skip_special_tokens=False) for k, ids in rows}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_library_ids(name):
    path, rng = public_tokenizers.path(name), np.random.default_rng(7)
    parts = list(" \t\n\r\x0b\x1c\x85\xa0\u180e\u2003\u200b\u2028\u3000'\u0301aA\u03a3\u0130e9!") + ["'s", " the", "don't", "  ", "<|endoftext|>", "\u4e2d\u6587", "\U0001f600"]
    parts += list("\x7f\x85\xad\xb2\xb5\xbc\xd7\xc9\xe8\xff,.;()") + ["Word", "\u00c9l\u00e8ve", "x2.5", "it's"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.library_ids(path, texts)] == want


def test_token_counts(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    t = Tokenizer(models.Unigram(*unigram.vocabulary(path)))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.SPACE, prepend_scheme="always", split=True)
    assert dict(unigram.count_tokens(docs, path).collect()) == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)}


def test_token_count_ties():
    pieces = [("?", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), (unigram.SPACE, -1.0), (unigram.SPACE + "a", -2.0)]
    t, c, rng = Tokenizer(models.Unigram(pieces, 0, False)), unigram.Counter(pieces, False), np.random.default_rng(5)
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.SPACE, prepend_scheme="always", split=True)
    for _ in range(300):
        x = "".join(rng.choice(list("aabbc d"), 12))
        assert c.text(x) == len(t.encode(x).ids)


def test_huffman(docs):
    files = huffman.write_ids(docs, WORD)
    again = files.sparkSession.newSession().read.parquet(*files.inputFiles())  # by path, in another session
    t, start = Tokenizer.from_file(WORD), 0
    for r in sorted(huffman.read_ids(again).collect()):
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.ids, r.start, r.n_tokens) == (ids, start, len(ids))
        start += len(ids)


def test_code_lengths_are_complete():
    n = huffman.code_lengths(np.arange(1, 5000) ** 3)
    assert n.max() <= huffman.LIMIT and sum(2.0 ** -int(x) for x in n) == 1


def test_packing():
    rng, p, full = np.random.default_rng(1), packing.Packer(64), []
    sizes = rng.integers(1, 200, 300)
    for d, n in enumerate(sizes):
        full += p.add(d, np.arange(n, dtype="<u4"))
    full += p.close()
    got = sorted((x[0], x[1], x[2].size) for s in full for x in s)
    assert sum(n for *_, n in got) == sizes.sum() and all(sum(x[2].size for x in s) in (1, 2, 4, 8, 16, 32, 64) for s in full)


def test_secrets():
    s = secrets.scanner()
    rng = np.random.default_rng(2)
    parts = ["token", "=", ":", " ", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "xyz", "PASSWORD", "api_key", "\"", "-"]
    for _ in range(300):
        data = "".join(rng.choice(parts, 20)).encode()
        want = []
        for k, rule in enumerate(secrets.BASE):
            for m in re.compile(rule.pattern.encode(), re.I if rule.either_case else 0).finditer(data):
                if len(m[rule.group]) >= rule.least:
                    want.append((m.start(), m.end(), k))
        assert [x for x in s.spans(data) if x[2] < 3] == sorted(want)


def test_redact_leaves_no_key_line(spark):
    rng = np.random.default_rng(8)
    b64 = lambda n: "".join(rng.choice(list("ABCDefgh0189+/"), n))
    body = [b64(64) for _ in range(5)] + [b64(10) + "=="]
    first, last = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    key = "\n".join([first, *body, last])
    fields = "\r\n".join([first, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123", "", *body, last])
    cut_off = "\n".join([first, *body[:2], b64(9)])
    texts = [f"a {x} z" for x in (key, fields, key.replace("\n", "\\n"), key.replace("\n", " "), f"{key}\n{key}")] + [f"a {cut_off}\nmore of the text", f"a {first} is a line z"]
    texts += [f"a {k}{'A1b2' * 9} z" for k in ("ghp_", "ghr_", "github_pat_")] + ["a github_pat_short z"]
    got = [r.text for r in secrets.redact(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got == ["a [pem] z"] * 4 + ["a [pem]\n[pem] z", "a [pem]\nmore of the text", "a [pem] is a line z"] + ["a [github] z"] * 3 + ["a github_pat_short z"]
    df = spark.createDataFrame([(0, f"\u4e2d {key} z")], "doc_id long, text string")
    assert [tuple(s) for s in secrets.find_secrets(df).first().spans if s.kind == "pem"] == [(2, 2 + len(key), "pem")]


def test_simhash(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(TEXTS) and got[0].fingerprint == "0" * 16 and got[1].component_id == 0 and got[3].component_id == 2


def test_keep_one_with_null_ids(spark):
    rng = np.random.default_rng(11)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (None, c), (5, c), (3, c), (7, d), (None, None), (None, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, a), (0, b), (3, c), (7, d), (0, "")])


def test_forest():
    v = [int(x) for x in np.random.default_rng(3).integers(0, 1 << 12, 300)]
    links, root = simhash.forest(v, 1), {x: x for x in v}
    assert all((a ^ b).bit_count() <= 1 for a, b in links) and len(links) < len(v)


def test_passages(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = words(60)
    texts = [f"{words(100)} {shared} {words(80)}", f"{words(30)} {shared} {words(90)}", words(300), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r) for r in passages.repeated_passages(df).collect()] == [(1, 30, 90, 0)]
    kept = dict(passages.cut_repeats(df).collect())
    assert shared in kept[0] and shared not in kept[1] and kept[2] == texts[2]


def test_candidates_with_many_open_groups():
    link = lambda k, c, fc: (c << 32 | 30 << 20 | 30 << 8 | 1 << k, fc << 32 | 30 << 20 | 30 << 8 | 1 << k)
    links = [link(0, 1000, 1000), *(link(1, 1001, 2000 + 100 * i) for i in range(20)), link(2, 1002, 1002)]
    first = passages.spans_of(links)[0]
    assert first == {"a": 970 - passages.BESIDE, "b": 1032 + passages.BESIDE, "x": 970 - passages.BESIDE, "y": 1032 + passages.BESIDE}


def _tree(h, least):
    """Windows by the tree's definition."""
    out, todo = [], [(0, h.size)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least:
            c = lo + int(h[lo:hi].argmin())
            out.append((lo, c, hi - 1))
            todo += ((lo, c), (c + 1, hi))
    return sorted(out, key=lambda w: w[1])


@pytest.mark.parametrize(("n", "kinds"), [(0, 9), (45, 9), (46, 2), (47, 10**9), (200, 30), (1500, 10**9)])
def test_windows_are_those_of_the_tree(n, kinds):
    h = np.random.default_rng(n).integers(1, kinds + 1, n)
    x = np.concatenate([[0], (h << 21) + np.arange(1, n + 1), [0]]).astype(np.uint64)
    left, c, right = passages.windows(x)
    assert [(a - 1, b - 1, e - 1) for a, b, e in zip(left.tolist(), c.tolist(), right.tolist(), strict=True)] == _tree(h, passages.LEAST)


def _planted(rng, passages_, lines, others):
    """Texts of random words and single frequent lines, and passages of three frequent lines in two texts each."""
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    line = [words(20) for _ in range(lines)]
    trios = [rng.permutation(lines)[:3] for _ in range(passages_)]
    texts = [" ".join(f"{words(30)} {line[x]}" for x in rng.integers(0, lines, 6)) for _ in range(others)]
    for trio in [*trios, *trios]:
        parts = [f"{words(30)} {line[x]}" for x in rng.integers(0, lines, 4)]
        texts.append(" ".join([*parts[:2], words(10), *(line[x] for x in trio), words(10), *parts[2:]]))
    return texts


@pytest.mark.parametrize(("lines", "others"), [(5, 100), (40, 300)])
def test_passages_of_frequent_lines(spark, lines, others):
    texts, n = _planted(np.random.default_rng(lines), 8, lines, others), 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = {}
    for r in passages.repeated_passages(df).collect():
        marked.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    for doc in range(others + n, others + 2 * n):  # 110 words, then the passage of 60
        assert set(range(110, 170)) <= marked.get(doc, set())


@pytest.mark.parametrize(("n", "at", "edit"), [(95, 45, 5), (100, 47, 6), (100, 60, 5), (105, 50, 7), (90, 43, 5)])
def test_passages_with_one_long_edit(n, at, edit):
    rng = np.random.default_rng(n + at)
    mine = rng.integers(0, 2**62, 60 + n + 60)
    words = mine.copy()
    words[60 + at : 60 + at + edit] = rng.integers(0, 2**62, edit)
    words[:60], words[60 + n :] = rng.integers(0, 2**62, 60), rng.integers(0, 2**62, 60)
    a, b = (passages.Words([" ".join(map(str, w)).encode()]).shingles(passages.SHINGLE)[0].view(np.int64) for w in (mine, words))
    both = np.intersect1d(a[60 : 60 + n - 4], b[60 : 60 + n - 4]).size
    assert both / (2 * (n - 4) - both) >= passages.SIMILAR and passages.verify(a, b) == [(60, 60 + n - 5)]


def test_passages_similar_stretch_in_a_run_that_is_not():
    rng = np.random.default_rng(9)
    mine = rng.integers(0, 2**62, 400)
    other = mine.copy()
    other[[30, 70, 110]] = 1, 2, 3  # scattered edits, similar
    other[150::4] = rng.integers(0, 2**62, 63)  # too many
    runs = passages.verify(mine, other)
    assert runs and runs[0][0] == 0 and 149 <= runs[0][1] < 250


def test_media():
    for t in (b"", b"abc", bytes(range(256)) * 20):
        p = media.payload(t)
        assert len(p) % 576 == 0 and media.from_wav(media.to_wav(p)) == p


def test_mixing(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in enumerate(TEXTS)}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in words.items() if i not in held for w in ws)
    n = sum(c.values())
    for block_bytes in (1, 10**6):
        got = {r.doc_id: r for r in mixing.score_texts(docs, block_bytes=block_bytes).collect()}
        assert got.keys() == words.keys() and got[2].score == got[3].score
        for i, r in got.items():
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(words[i]), sum(c[w] > 0 for w in words[i]), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in words[i])) and r.score < 0


def test_spelling_is_a_distribution():
    """Of all single bytes; words of the same first byte share its probability."""
    seen = mixing.Tokens([mixing.stream(b"the then thin a an and"), mixing.stream(b"a the")])
    table = np.zeros((mixing.PREDICTORS, 2 * mixing.SLOTS), np.uint32)
    c = mixing.Choices(seen, seen.distinct)
    for k, slot in enumerate(c.slot):
        np.add.at(table[k], (slot * 2 + c.bit).ravel(), 1)
    table = table.reshape(mixing.PREDICTORS, -1, 2)
    table = table[:, :, 1] << np.uint32(16) | table[:, :, 0]
    weights = np.random.default_rng(6).random(mixing._start().shape, np.float32)
    one_each = mixing.Tokens([bytes([b]) + b" " for b in range(256) if b not in (mixing.GAP, mixing.END)])
    c = mixing.Choices(one_each, one_each.distinct)
    odds, gate = c.odds(table, 0)
    lost = np.logaddexp(0, -sum(o * weights[:, k][gate] for k, o in enumerate(odds))).sum(1)
    first = np.exp(-lost[np.concatenate([[True], c.token[1:] != c.token[:-1]])])
    assert 0.3 < first.sum() < 1 and first[ord("a") - 1] > first[ord("y") - 2]


def test_predictions_sum_to_one():
    """Of whole words, for a text's last token: over all words that can come there, spelling left out."""
    words, text = ["a", "b", "c", "d"], "a b a b a c"
    n = {"a ": 5, "b ": 3, "c ": 2, "d ": 0, "\n": 4}
    total = np.zeros(3)
    for w in words:
        t = mixing.Tokens([mixing.stream(f"{text} {w}".encode())])
        kind, count = np.zeros(t.code.size, int), np.array([n[bytes(t.buf[a : a + s]).decode()] for a, s in zip(t.first, t.size, strict=True)])
        p = mixing.predictions(t, kind, count, count, np.array([14] + [0] * mixing.CLASSES), np.zeros(t.code.size), np.zeros(t.code.size))[0]
        total += p[-2, [0, 1, 3]]
    assert np.allclose(total, [10 / 14, 10 / 14, 1])  # the end token has the rest of the first two


def test_shares_follow_what_predicts():
    rng = np.random.default_rng(5)
    p = np.full((2000, mixing.PREDICTIONS), 1e-4)
    p[np.arange(2000), rng.choice(mixing.PREDICTIONS, 2000, p=[0.7, 0.1, 0.1, 0.1])] = 0.5
    shares = mixing.fit_shares(p, np.zeros(2000, int), rounds=50)
    assert np.allclose(shares[0], [0.7, 0.1, 0.1, 0.1], atol=0.05) and np.allclose(shares.sum(1), 1)


def test_word_classes_by_shared_documents(spark):
    rows = [(a, b, 90 if a // 3 == b // 3 else 3) for a in range(6) for b in range(6)]
    got = mixing.word_classes(spark.createDataFrame(rows, "a long, b long, n long"))
    assert len({got[k] for k in range(3)}) == 1 and len(set(got.values())) == 2


def test_mixing_beats_word_counts_on_held_out_texts(spark):
    """Two invented languages of syllables: spelling, classes and the text's own words all tell something."""
    rng = np.random.default_rng(12)
    tongues = [[["ka", "to", "mi", "ru"], ["shi", "ne"]], [["bel", "gro", "vin", "ast"], ["olm", "dur"]]]

    def text(k):
        syllables, common = tongues[k]
        word = lambda: common[rng.integers(2)] if rng.random() < 0.3 else "".join(rng.choice(syllables, int(rng.integers(2, 6))))
        return " ".join(word() for _ in range(120))

    df = spark.createDataFrame([(i, text(i % 2)) for i in range(300)], "doc_id long, text string")
    got = [r for r in mixing.score_texts(df).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > sum(r.base_score for r in got)


def _words_of(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def test_added_secrets(spark):
    a = "A1b2C3d4E5"
    found = {"slack": f"xoxb-{a * 3}", "google_key": "AIza" + (a * 4)[:35], "stripe": "sk_live_" + a * 3, "npm": "npm_" + (a * 4)[:36], "web_token": f"eyJ{a}.eyJ{a}.{a}", "mail_api": f"SG.{a * 2}.{a * 2}", "phone_api": "SK" + "0a" * 16, "login": "://me:pa55word@", "bearer": "Bearer " + a * 3, "aws_session": "ASIA" + "Z9" * 8}
    texts = [f"\u4e2d see {x} now" for x in found.values()] + ["eyJust a word", "AIza short", "basic understanding of internationalization", "http://host:80/x", "xoxb-1"]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: {s.kind: texts[r.doc_id][s.start : s.end] for s in r.spans} for r in got}
    assert all(spans[i].get(kind) == x for i, (kind, x) in enumerate(found.items())) and not any(spans[i] for i in range(len(found), len(texts)))


@pytest.mark.parametrize("unit", [" ", "\n", "\t ", "a", "\u4e2d"])
def test_texts_of_two_million_characters(spark, unit):
    text = unit * (2_000_000 // len(unit))
    df = spark.createDataFrame([(0, text), (1, "short")], "doc_id long, text string").coalesce(1)
    byte = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(df, byte, with_ids=False).collect()
    want = len(Tokenizer.from_file(byte).encode(text, add_special_tokens=False).ids) + 1
    assert sum(p.length for p in pieces if p.doc_id == 0) == want and {p.doc_tokens for p in pieces if p.doc_id == 0} == {want}
    assert unigram.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 2
    assert passages.repeated_passages(df).count() == 0 and simhash.near_duplicates(df).count() == 2


def test_rows_of_one_id_or_none(spark):
    rng = np.random.default_rng(13)
    shared = _words_of(rng, 70)
    texts = [(1, f"{_words_of(rng, 60)} {shared}"), (5, f"{_words_of(rng, 200)} {shared} {_words_of(rng, 20)}"), (5, "short"), (None, f"{shared} {_words_of(rng, 30)}"), (None, None)]
    df = spark.createDataFrame([(i, t, "s", 7.5, 1) for i, t in texts], "doc_id long, text string, n_chars string, own_id double, __spans int")
    found = {(r.doc_id or 99, r.first_word, r.end_word, r.source_id) for r in passages.repeated_passages(df).collect()}
    assert found - {(99, 0, 70, 5)} == {(5, 200, 270, 1), (99, 0, 70, 1)}
    got = passages.cut_repeats(df)
    assert got.columns == df.columns and got.schema["n_chars"].dataType.simpleString() == "string"
    rows = got.collect()
    assert sum(shared in (r.text or "") for r in rows) == 1 and {(r.n_chars, r.own_id, r["__spans"]) for r in rows} == {("s", 7.5, 1)} and "short" in [r.text for r in rows] and len(rows) == 5


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh " + _words_of(np.random.default_rng(3), 80), "x", 2.5, "q")], "doc_id long, text string, n_chars string, quality_a double, Quality string")
    for f in (secrets.redact, quality.keep_good, simhash.keep_one, passages.cut_repeats):
        got = f(df)
        assert got.columns == df.columns
        assert [(r.n_chars, r.quality_a, r.Quality) for r in got.collect()] == [("x", 2.5, "q")]


def _quality_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for ps in at.values() if len(ps) > 1 for p in ps for j in (p, p + 1, p + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = np.random.default_rng(21)
    texts = [None, "", " \t\n ", "a b c a b c a b c", "x\nx\n x\n\n\u00e9 # $|", *("".join(rng.choice(list("ab \n\t#$\u4e2d"), int(rng.integers(0, 200)))) for _ in range(40)), _words_of(rng, 120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_report(df).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], _quality_of(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert got[len(texts) - 1].kept and {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}


def test_simhash_against_brute_force(spark):
    import xxhash

    rng, texts = np.random.default_rng(17), []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 500, 150)]
        for edits in (0, 0, 1, 3, 30):
            some = list(words)
            for at in rng.integers(0, 150, edits):
                some[at] = f"v{rng.integers(99)}"
            texts.append("  ".join(some).replace("w1", "W1"))
    texts += [None, "", "one two", "One two"]

    def print_of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        runs = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            root[i] = min(root[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= simhash.RADIUS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in enumerate(prints)}


def test_level_is_that_of_the_least_sum_of_squares():
    rng, p = np.random.default_rng(19), packing.Packer(16)
    for d in range(400):
        n = int(rng.integers(1, 16))
        levels = [0] + [f for f in range(1, 17 - n) if p.counts[f]]

        def squares(level):
            c = p.counts.copy()
            c[level] -= level > 0
            c[level + n] += level + n < 16
            return int((c[1:16] ** 2).sum())

        assert p.level(n) == min(levels, key=lambda x: (squares(x), -x))
        list(p.add(d, np.arange(n, dtype="<u4")))


def test_pack_columns(spark):
    texts = [None, "", *(_words_of(np.random.default_rng(k), 40 * k) for k in range(1, 12))]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD, length=64).collect()
    t, filled = Tokenizer.from_file(WORD), {}
    for i, text in enumerate(texts):
        ids, at = t.encode(text or "", add_special_tokens=False).ids + [0], 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.ids, r.doc_tokens) == (at, ids[at : at + r.length], len(ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
            at += r.length
        assert at == len(ids)
    for parts in filled.values():
        size = 0
        for offset, n in sorted(parts):
            assert offset == size
            size += n
        assert size in (1, 2, 4, 8, 16, 32, 64)


def test_media_digest(spark):
    import hashlib

    texts = [None, "", "abc", "\u4e2d" * 192, "x y " * 3000]
    for r in media.store_audio(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digest=True).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (max(-(-len(data) // 576), 1) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(media.to_wav(payload)).hexdigest())


def test_peaks_of_two_tones():
    at = np.arange(576 * 20)
    found = media.peaks((128 + 50 * np.sin(2 * np.pi * 40 / 576 * at) + 30 * np.sin(2 * np.pi * 100 / 576 * at)).round().astype(np.uint8).tobytes())
    assert all({40, 100} <= set(found[found[:, 0] == f, 1].tolist()) for f in range(5, 30))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (lambda d: bpe.encode(d, WORD), mixing.score_texts, lambda d: unigram.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")), simhash.near_duplicates, passages.repeated_passages, secrets.find_secrets, lambda d: packing.pack(d, WORD), lambda d: huffman.read_ids(huffman.write_ids(d, WORD)), quality.keep_good, media.store_audio, secrets.redact, simhash.keep_one, passages.cut_repeats):
        assert f(none).count() == 0


def test_media_is_read_back_from_its_table(spark):
    texts = [None, "x y " * 500, "x y " * 500]
    rows = media.store_audio(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, media string")).orderBy("doc_id").collect()
    for r in rows:
        data = media.from_wav(bytes(r.media))
        assert data == media.payload((texts[r.doc_id] or "").encode())
        assert [list(x) for x in media.fingerprint(data)] == [r.times, r.codes]
    assert rows[1][1:] == rows[2][1:]
