"""The registered queries against their contracts, restated here, on the smallest table."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from math import isclose, log10

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from terrane.llm import queries

SF = "/root/testdata/sf0.001"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def _crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def _ids(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t, lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _got(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    _, encode = _ids("byte_bpe_50k.json")
    pieces, by_doc, by_sequence = _got(spark, "op1_packing"), {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, rows in by_doc.items():
        ids, at = [*encode(texts[d]), 0], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), _crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024


def test_op4(spark, texts):
    prints = {}
    for d, text in texts.items():
        words = _words(_lower(text))
        runs = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {}
    for d in sorted(prints):
        if d not in component:
            component[d], todo = d, [d]
            while todo:
                a = todo.pop()
                for b in prints:
                    if b not in component and (prints[a] ^ prints[b]).bit_count() <= 4:
                        component[b] = d
                        todo.append(b)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in _got(spark, "op4_simhash")} == {d: (f"{prints[d]:016x}", component[d]) for d in texts}


RULES = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A), "access": (r"AKIA[A-Z0-9]+", 0, 20, 0), "hex": (r"[0-9a-f]+", 0, 24, 0)}


def test_op5(spark, texts):
    for r in _got(spark, "op5_secrets"):
        found = [(m.start(), k, kind, m.end()) for k, (kind, (rule, group, least, flags)) in enumerate(RULES.items()) for m in re.finditer(rule, texts[r.doc_id], flags) if len(m[group]) >= least]
        listed = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[2] == kind for f in found) for kind in RULES)
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in RULES] == listed and [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)


def test_op6(spark, texts):
    t, encode = _ids("word_bpe_49k.json")
    for r in _got(spark, "op6_bpe"):
        ids = encode(texts[r.doc_id])
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(t.decode(ids, skip_special_tokens=False).encode()))


def test_op7(spark, texts):
    for r in _got(spark, "op7_quality"):
        words = _words(texts[r.doc_id])
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times, again = Counter(runs), set()
        for i, run in enumerate(runs):
            again |= {i, i + 1, i + 2} if times[run] > 1 else set()
        lines = [x for x in texts[r.doc_id].split("\n") if _words(x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and r.kept)


def test_op8(spark, texts):
    seen = {}
    for r in _got(spark, "op8_media"):
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert seen.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op9(spark, texts):
    _, encode = _ids("word_bpe_49k.json")
    at = 0
    for r in sorted(_got(spark, "op9_huffman"), key=lambda r: r.doc_id):
        ids = [*encode(texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), _crc(ids))
        at += len(ids)


def test_op10(spark, texts):
    tokens = {d: [*_words(_lower(t)), ""] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(w for d, of in tokens.items() if not held[d] for w in of)
    total, kinds = sum(c.values()), len(c)
    for r in _got(spark, "op10_mixing"):
        of = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(of), sum(c[w] > 0 for w in of), total)
        assert isclose(r.base_score, sum(log10((c[w] + 1) / (total + kinds + 1)) for w in of), rel_tol=1e-9) and r.score < 0
