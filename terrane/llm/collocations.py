"""Phrase collocations: weighted n-gram counts, scored by the weakest cut of each phrase.

Texts are cut into pieces; identical pieces of a language are counted once with their multiplicity.  Tasks tell the n-grams of
their pieces apart by sorted numbers, so that each n-gram leaves a task once, in a compressed row for its hash bucket; duckdb
sums each bucket out of core.  Phrases frequent enough then send requests for the counts of their parts to where those are
(a shuffled join by language and part), and the answers come together by phrase.

Defined results: a null text has no words, a null language is `und`; repeated rows count each; empty pieces have no words; ties
of a score go by count, then by the phrase's bytes; an empty table has no phrases.  Texts are taken whole.  Other columns are
not looked at, whatever their names.  Counts are exact up to 10^15.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.llm.common import mix64, written

#: Words of a phrase at most, its least count, rows of a language, share of a longer phrase (in hundredths) that drops it.
MOST, LEAST, TOP, SHARE = 3, 10, 2000, 50
#: Bytes of pieces whose n-grams a task tells apart at a time; memory that duckdb takes before it goes to disk, in MB.
CHUNK, MEMORY = 8 << 20, 384


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece, weight: each distinct piece of a language and how often it occurs."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]+")).alias("piece"))
    return each.where(F.col("piece").rlike(r"[^\x20\x09]")).groupBy("lang", "piece").agg(F.count("*").alias("weight"))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, in order of keys; the sum of its weights; the number of each place's key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1))
    number = np.empty(keys.size, np.int64)
    number[order] = np.repeat(np.arange(first.size), np.diff(first, append=keys.size))
    return order[first], np.add.reduceat(weights[order], first), number


class Grams:
    """The distinct n-grams of 1 to `most` words of some pieces, as numbers of their words.

    lang: each one's language; codes: its words, numbered from 1 by bytes, 0 for none; c: its count; hash: of language and words.
    One without words stands for all words of its language.
    """

    def __init__(self, lang: pa.Array, piece: pa.Array, weight: np.ndarray, most: int):
        split = pc.ascii_split_whitespace(piece)
        words, of = split.flatten(), np.repeat(np.arange(len(piece)), np.diff(split.offsets.to_numpy()))
        there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        words, of = words.filter(pa.array(there)), of[there]
        names, coded = lang.dictionary_encode(), words.dictionary_encode()
        by_bytes = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy(zero_copy_only=False)
        rank = np.empty(by_bytes.size, np.int64)
        rank[by_bytes] = np.arange(by_bytes.size)
        self.names, self.words = names.dictionary, coded.dictionary.cast(pa.large_binary()).take(pa.array(by_bytes))
        code = rank[coded.indices.to_numpy(zero_copy_only=False)]
        raw = self.words.to_pylist()
        #: Bytes that each word has in common with the one before it.
        self.shared = np.array([0, *(len(os.path.commonprefix(two)) for two in zip(raw, raw[1:], strict=False))][: len(raw)], np.int64)
        word_hash = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()], np.uint64)
        name_hash = np.array([xxhash.xxh3_64_intdigest(n, 1) for n in self.names.to_pylist()], np.uint64)
        language, weights = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of], weight[of]
        langs, counts, hashes = [np.arange(len(self.names))], [np.bincount(language, weights, len(self.names)).astype(np.int64)], [name_hash]
        codes = [np.zeros((most, len(self.names)), np.int32)]
        number, at = language.copy(), np.arange(code.size)
        for n in range(1, most + 1):
            at = at[at < code.size - n + 1]
            at = at[of[at] == of[at + n - 1]]
            if not at.size:
                break
            place, c, number[at] = _sums(number[at] * np.int64(len(self.words)) + code[at + n - 1], weights[at])
            start = at[place]
            h, own = name_hash[language[start]], np.zeros((most, start.size), np.int32)
            with np.errstate(over="ignore"):
                for j in range(n):
                    own[j] = code[start + j] + 1
                    h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + word_hash[code[start + j]])
            langs, codes, counts, hashes = [*langs, language[start]], [*codes, own], [*counts, c], [*hashes, h]
        self.lang, self.codes, self.c, self.hash = np.concatenate(langs), np.concatenate(codes, 1), np.concatenate(counts), np.concatenate(hashes)

    def packed(self, chosen: np.ndarray) -> tuple[bytes, bytes]:
        """(words, grams) of the chosen ones, compressed; of the words' numbers low and high bytes stand apart, which packs better."""
        used, codes = np.unique(self.codes[:, chosen], return_inverse=True)
        codes = codes.reshape(-1, chosen.size) + (0 if used.size and used[0] == 0 else 1)
        planes = [pa.array((row >> shift).astype(np.uint8)) for row in codes for shift in (0, 8, 16, 24)]
        grams = pa.RecordBatch.from_arrays([self.names.take(pa.array(self.lang[chosen])), pa.array(self.c[chosen]), *planes], ["lang", "c", *(f"p{k}" for k in range(len(planes)))])
        return self._fronted(used[used > 0] - 1), _written(grams)

    def _fronted(self, at: np.ndarray) -> bytes:
        """Words in order: of each the bytes shared with the one before, and the rest."""
        if not at.size:
            return struct.pack("<QQ", 0, 0)
        shared = np.concatenate([[0], np.minimum.reduceat(self.shared[: at[-1] + 1], at[:-1] + 1)]) if at.size > 1 else np.zeros(1, np.int64)
        offsets, data = np.frombuffer(self.words.buffers()[1], np.int64)[: len(self.words) + 1], np.frombuffer(self.words.buffers()[2], np.uint8)
        shared = np.minimum(shared, 255)
        sizes = offsets[at + 1] - offsets[at] - shared
        ends = np.cumsum(sizes)
        rest = data[np.arange(ends[-1]) + np.repeat(offsets[at] + shared - ends + sizes, sizes)]
        raw = shared.astype(np.uint8).tobytes() + sizes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + rest.tobytes()
        return struct.pack("<QQ", at.size, len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _words(packed: bytes) -> list[bytes]:
    n, size = struct.unpack_from("<QQ", packed)
    if not n:
        return []
    raw = pa.decompress(packed[16:], size, "zstd", asbytes=True)
    sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, n).reshape(4, n).T).view("<u4").ravel().tolist()
    out, before, at = [], b"", 5 * n
    for shared, more in zip(raw[:n], sizes, strict=True):
        before = before[:shared] + raw[at : at + more]
        at += more
        out.append(before)
    return out


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(words: bytes, grams: pa.Buffer) -> pa.RecordBatch:
    """lang, phrase, c of what Grams.packed() gave."""
    batch = pa.ipc.open_stream(grams).read_next_batch()
    word, planes = pa.array([None, *_words(words)], pa.binary()).cast(pa.string()), [c.to_numpy().astype(np.int64) for c in batch.columns[2:]]
    parts = [word.take(pa.array(sum(p << 8 * k for k, p in enumerate(planes[i : i + 4])))) for i in range(0, len(planes), 4)]
    return pa.RecordBatch.from_arrays([batch.column("lang"), pc.binary_join_element_wise(pc.fill_null(parts[0], ""), *parts[1:], " ", null_handling="skip"), batch.column("c")], schema=_GRAM)


_GRAM = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])


def _packed(pieces_: DataFrame, most: int, buckets: int) -> DataFrame:
    """bucket, and the n-grams of a chunk of pieces that belong there."""

    def rows(lang: list, piece: list, weight: list) -> Iterator[pa.RecordBatch]:
        found = Grams(pa.concat_arrays(lang), pa.concat_arrays(piece), np.concatenate(weight), most)
        bucket = (found.hash % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        for a, b in zip(cuts, cuts[1:], strict=False):
            words, grams = found.packed(order[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([bucket[order[a]]], pa.int64()), pa.array([words], pa.binary()), pa.array([grams], pa.binary())], ["bucket", "words", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            piece = batch.column("piece")
            held[0].append(batch.column("lang"))
            held[1].append(piece)
            held[2].append(batch.column("weight").to_numpy())
            size += piece.nbytes
            if size >= CHUNK:
                yield from rows(*held)
                held, size = ([], [], []), 0
        if size:
            yield from rows(*held)

    return pieces_.mapInArrow(run, "bucket long, words binary, grams binary")


def _summed(packed: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of what occurs often enough, and of the empty phrase: each bucket's n-grams, streamed into duckdb.

    What doesn't fit duckdb's memory goes to the task's own scratch folder, as Spark's own spills do, and is gone with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        def opened() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for words, grams in zip(batch.column("words"), batch.column("grams"), strict=True):
                    yield unpacked(words.as_py(), grams.as_buffer())

        scratch = next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)
        with tempfile.TemporaryDirectory(dir=scratch) as spill, duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": spill, "preserve_insertion_order": False}) as db:
            db.register("grams", pa.RecordBatchReader.from_batches(_GRAM, opened()))
            yield from db.sql(f"SELECT lang, phrase, sum(c)::BIGINT AS f FROM grams GROUP BY lang, phrase HAVING sum(c) >= {int(least)} OR phrase = ''").to_arrow_reader(10_000)

    return packed.mapInArrow(run, "lang string, phrase string, f long")


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST, least: int = LEAST) -> DataFrame:
    """lang, phrase, f: n-grams of 1 to `most` words with at least `least` occurrences; the empty phrase has a language's words."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(pieces(docs, text_col, lang_col), most, 2 * n)
    return _summed(packed.repartition(2 * n, "bucket"), least)


def _part(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(counted: DataFrame, most: int = MOST, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one drops; counted: a table of counts()."""
    words = F.split("phrase", " ")
    candidates = counted.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.size(words).alias("k"))
    known = counted.select("lang", F.col("phrase").alias("part"), "f")
    # Requests: of each cut its two parts, and of the empty phrase, which has the language's words.
    cut = lambda i: F.array(F.struct(i.alias("cut"), F.lit(False).alias("rest"), _part(F.col("words"), F.lit(1), i).alias("part")), F.struct(i.alias("cut"), F.lit(True).alias("rest"), _part(F.col("words"), i + 1, F.col("k") - i).alias("part")))
    asked = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut))
    requests = candidates.select("lang", "phrase", "a", F.explode(asked).alias("q")).select("lang", "phrase", "a", "q.*")
    answers = requests.join(known, ["lang", "part"])
    cuts = answers.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(~F.col("rest"), F.col("f"))).alias("l"), F.max(F.when(F.col("rest"), F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    # Every shorter phrase inside a candidate learns of the most frequent one around it.
    inner = lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: _part(F.col("words"), i, size))
    inside = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), inner)))
    around = candidates.where("k > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * wide("longer") < share * wide("a"), F.lit(True)))
    totals = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return left.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    found = scored(written(counts(docs, text_col, lang_col, most, least), "counts"), most, share)
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first rows are among the first of each of its parts, so no task sorts a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*by))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
