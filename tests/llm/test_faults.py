"""Rules on plain prose, and the removal of tables."""

import glob

import pytest

import corpus_pipeline
from terrane.llm import common, secrets

PROSE = [
    "https://x.org/blog/task-management-software-for-small-business-teams",
    "see https://x.org/risk-assessment-of-the-long-and-winding-road-to-nowhere and desk-sk-learn-something-about-anything-in-the-world",
    "sk-a-slug-of-plain-words-that-goes-on-for-more-than-forty-letters",
    "xoxb-is-how-a-token-of-that-chat-begins-as-everyone-knows-well",
    "mynpm_packagewithaverylongnameandnodigitsinitatallreally thf_" + "w" * 40,
    "npm_" + "w" * 40 + " glpat-" + "abcdefghij-klmnopqrst-uvwxyz hf_" + "z" * 40,
    "the bearer of this letter may be trusted; basic instruction for beginners",
]
KEYS = [
    ("model_api", "sk-proj-4f9Kd83jfLs0dkfj39fkLdkf93kfldkf93Kf"), ("slack", "xoxb-123456789012-abcdefGHIJ"), ("npm", "npm_" + "aB3d" * 9), ("gitlab", "glpat-" + "aBcDeFgHiJkLmNoPqRsT"),
    ("model_hub", "hf_" + "AbCdEfGhIj" * 4), ("github", "ghp_" + "a1B2" * 9), ("aws_session", "ASIA" + "Q7" * 8),
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_has_no_secret(text):
    assert secrets.scanner().spans(text.encode()) == []


@pytest.mark.parametrize("kind,key", KEYS)
def test_keys_are_found(kind, key):
    s = secrets.scanner()
    for before in ("", " ", "=", '"', "é", "中", "(", "https://x.org/?k="):
        at = len(before.encode())
        assert (at, at + len(key), kind) in [(a, b, s.rules[k].kind) for a, b, k in s.spans(f"{before}{key} end".encode())]


def test_a_key_within_a_refused_match():
    """What stands before a key, and is refused, uses none of it up."""
    s = secrets.scanner()
    data = b"task-sk-proj-4f9Kd83jfLs0dkfj39fkLdkf93kfldkf93Kf"
    assert [(a, b) for a, b, k in s.spans(data) if s.rules[k].kind == "model_api"] == [(5, len(data))]


@pytest.mark.parametrize("root", ["file:{}", "file://{}", "{}"])
def test_remove(spark, tmp_path, root, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: root.format(tmp_path))
    one, other = common.written(spark.range(5).toDF("a"), "one"), common.written(spark.range(5).toDF("a"), "other")
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    assert len(glob.glob(f"{tmp_path}/*-*")) == 2
    common.remove(one.where("a > 1"))
    common.remove(spark.read.parquet(str(tmp_path / "mine")))
    assert [p.rpartition("/")[2].partition("-")[0] for p in sorted(glob.glob(f"{tmp_path}/*"))] == ["mine", "other"] and other.count() == 5
    common.remove(other)
    assert glob.glob(f"{tmp_path}/*-*") == []


def test_pipeline_leaves_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file:{tmp_path}")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.rpartition("/")[2].partition("-")[0] for p in glob.glob(f"{tmp_path}/*")] == ["pipeline"]
