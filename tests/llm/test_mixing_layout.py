"""Scores of language models are a table's own, however it is cut up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import mixing

SF = "/root/testdata/sf0.01"


def test_levels():
    p = np.array([[0.5, 0.25, 0.0, 1e-9], [1.0, 1.0, 0.5**0.5, 2.0**-15], [0, 0, 0, 0]])
    got, gate = mixing.of_levels(mixing.levels(p, np.array([3, 0, 11])))
    assert gate.tolist() == [3, 0, 11]
    assert np.allclose(got, [[1, 0.5, 0, 0], [1, 1, 0.5**0.5, 2.0**-15], [1, 1, 1, 1]])


def test_shares_of_levels_are_near_those_of_tokens():
    rng = np.random.default_rng(1)
    p, gate = rng.random((20_000, mixing.PREDICTIONS)) ** 6, rng.integers(0, mixing.FAR_GATES, 20_000)
    key, n = np.unique(mixing.levels(p, gate), return_counts=True)
    assert np.abs(mixing.fit_shares(*mixing.of_levels(key), times=n.astype(float)) - mixing.fit_shares(p, gate)).max() < 0.02


@pytest.fixture(scope="module")
def scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for slices, shuffled, block in ((1, 8, mixing.BLOCK_BYTES), (6, 3, 100_000), (16, 8, 30_000)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            dealt = docs.repartition(slices, "doc_id") if slices > 1 else docs.coalesce(1)
            out.append({r.doc_id: r for r in mixing.score_texts(dealt, block_bytes=block).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return out


def test_scores_do_not_depend_on_partitions(scores):
    first = scores[0]
    for other in scores[1:]:
        assert other.keys() == first.keys()
        assert max(abs(other[d].score - first[d].score) / abs(first[d].score) for d in first) < 1e-9
        assert all((other[d].n_known, other[d].train_tokens) == (first[d].n_known, first[d].train_tokens) for d in first)


def test_frequent_words_are_those_of_all_texts(spark):
    texts = ["common " * 3 + f"rare{k} " * 5 for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    word = int(mixing.Tokens([mixing.stream(b"common")]).hash[:1].view(np.int64)[0])
    got = mixing._frequent(docs, 200)
    assert got[0] == word and len(got) == mixing.FREQUENT
    assert got == mixing._frequent(docs.select(F.col("doc_id"), "text").coalesce(1), 10**9)


def test_tokens_before_and_their_streams_equal_counting_one_by_one():
    rng = np.random.default_rng(3)
    streams = [b"\n", *(b"".join(b"w%d " % x for x in rng.integers(0, 9, n)) + b"\n" for n in (5, 1, 400, 0, 70)), b"\n"]
    t, want, docs = mixing.Tokens(streams), [], []
    for k, s in enumerate(streams):
        words = s.split(b" ")
        want += [words[:i].count(w) for i, w in enumerate(words)]
        docs += [k] * len(words)
    assert mixing.earlier(t).tolist() == want and t.doc.tolist() == docs
    assert mixing.earlier(mixing.Tokens([])).size == 0
