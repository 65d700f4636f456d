"""The corpus pipeline as a whole: planted cases, and each stage against its rule on what the stage before kept."""

import re

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terrane.llm import quality, simhash

PASSAGE = "beyond the quiet orchard stands " + " ".join(f"stone{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)) + " and nothing else was found"
SECRET = "AKIA" + "QWERTYUIOPASDFGHJKLZ"


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _documents(spark):
    """The documents of the smallest table with planted ones added; ids of those are 10,000 and above."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = quality.keep_good(docs).orderBy("doc_id").where(F.length("text").between(900, 4000)).limit(6).collect()
    plant = [
        good[0].asDict() | {"doc_id": 10_000},
        good[1].asDict() | {"doc_id": 10_001, "text": good[1].text + "\n" + PASSAGE},
        good[2].asDict() | {"doc_id": 10_002, "text": PASSAGE + "\n" + good[2].text[::-1]},
        good[3].asDict() | {"doc_id": 10_003, "text": good[3].text[::-1] + " key " + SECRET + " end"},
        good[4].asDict() | {"doc_id": 10_004, "text": None},
        good[5].asDict() | {"doc_id": 10_005, "text": "### $$$ |||"},
    ]
    return docs.unionByName(spark.createDataFrame(plant, docs.schema)), good[0].doc_id


def test_pipeline(spark, tmp_path):
    docs, copied = _documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "-")))
        previous, docs = docs, spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        if name != "packing":
            assert docs.columns == previous.columns
            tables.append({r.doc_id: r.text for r in docs.collect()})
    kept, single, cut, clean = tables

    verdicts = quality.quality_report(spark.read.parquet(str(tmp_path / "documents.parquet"))).where("kept").select("doc_id").collect()
    assert set(kept) == {r.doc_id for r in verdicts} and not {10_004, 10_005} & set(kept)

    prints = {d: _print(t) for d, t in kept.items()}
    root, changed = {d: d for d in prints}, True
    while changed:
        now = {d: min(root[e] for e, q in prints.items() if (p ^ q).bit_count() <= simhash.RADIUS) for d, p in prints.items()}
        root, changed = now, now != root
    assert set(single) == set(root.values()) and 10_000 not in single and copied in single

    assert set(cut) == set(single) and all(len(cut[d]) <= len(single[d]) for d in cut)
    assert {10_001, 10_002, 10_003} <= set(single) and sum(PASSAGE in (t or "") for t in cut.values()) == 1

    assert set(clean) == set(cut) and SECRET in cut[10_003] and not any(re.search("AKIA[A-Z0-9]{16}", t or "") for t in clean.values())
    assert all(clean[d] == t for d, t in cut.items() if not re.search(r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{24}|-----BEGIN|://|[-_A-Za-z0-9]{16}", t or ""))

    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in docs.orderBy("doc_id", "start").collect():
        assert r.start == len(pieces.setdefault(r.doc_id, []))
        pieces[r.doc_id] += r.ids
    assert pieces == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in clean.items()}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.start, r.ids_crc32) for r in run.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in docs.collect()}


def test_repeats_around_a_frequent_line_are_cut(spark):
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    lines = [words(38) for _ in range(12)]
    whole = [words(6) + lines[k % 12] + words(6) for k in range(96)]
    texts = [sum((words(30) + line for line in lines), []) for _ in range(80)] + [words(30) + x + words(30) for x in whole * 2]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = dict(corpus_pipeline.repeated_passages(spark, df, "").select("doc_id", "text").collect())
    assert all(len(kept[80 + 96 + k].split()) == 60 for k in range(96))
