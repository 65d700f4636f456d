"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from terrane.llm import bpe, collocations, huffman, media, mixing, packing, passages, quality, secrets, simhash, spelling, suffixes, unigram


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(_documents(spark, sf_dir))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 9).alias("probability"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir))
    spans = F.col("spans")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["kind"].isin(*(r.kind for r in secrets.BASE)))
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_audio(_documents(spark, sf_dir), digest=True)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_documents(spark, sf_dir))


def op9_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_ids(huffman.write_ids(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")), digest=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(_documents(spark, sf_dir))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_packing, op2_tokens, op3_passages, op4_simhash, op5_secrets, op6_bpe, op7_quality, op8_media, op9_huffman, op10_mixing, op11_suffixes, op12_collocations, op13_spelling)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k+n-1], ' ') AS w FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
seen AS (SELECT doc_id, n, k, array_to_string(ws[k:k+n-1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes)),
occ AS (SELECT doc_id, n, k, item_id FROM seen JOIN win USING (n, w)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM occ)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
_PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
f AS (SELECT lang, k, array_to_string(part, ' ') AS phrase, any_value(part) AS part, count(*) AS f FROM (SELECT lang, k, ws[i:i+k-1] AS part FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))) GROUP BY lang, k, phrase),
c AS (SELECT lang, phrase, part, k, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, k, part, a, i, array_to_string(part[1:i], ' ') AS one, array_to_string(part[i+1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, i, x.f AS l, y.f AS r, (1000000::HUGEINT * cuts.a * cuts.a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(part[1:2], ' '), array_to_string(part[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM worst LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000
"""
# The crc's table by its rule, then a fold over the bytes of each distinct run of a document.
_SPELLINGS = rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS t),
r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
bytes AS (SELECT run, c, list_concat(list_transform(string_split(concat(doc_id, ':'), ''), lambda x: unicode(x)), flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END))) AS bs FROM r),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bs::BIGINT[]), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) AS h FROM bytes, t),
v AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN concat(run[1:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word, c FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
wild AS (SELECT word, n, concat(word[1:i-1], '?', word[i+1:]) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
cut AS (SELECT DISTINCT word, n, concat(word[1:i-1], word[i+1:]) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.g = b.g AND a.word <> b.word
 UNION ALL SELECT cut.word, cut.n, v.word, v.n FROM cut JOIN v ON cut.g = v.word UNION ALL SELECT v.word, v.n, cut.word, cut.n FROM cut JOIN v ON cut.g = v.word),
best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, m FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) = 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, form AS following FROM f UNION ALL SELECT steps.word, f.word, f.form FROM steps JOIN f ON f.word = steps.following)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN steps ON steps.word = f.word AND steps.following IS NULL
"""
ORACLES: dict[str, str] = {"op11_suffixes": _LEAKS, "op12_collocations": _PHRASES, "op13_spelling": _SPELLINGS}
