"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.  Only a local master may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (at or "file:///tmp/checkpoints").rstrip("/")


#: Spark's setting that lets go of an execution's shuffle files when it ends.
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Paths of the tables of written() that are still there, by the name of their folder.
_made: dict[str, str] = {}


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Once it is written nothing reads the shuffle files that led to it, so they go at once.
    """
    spark = df.sparkSession
    name, before = f"{tag}-{uuid.uuid4().hex}", spark.conf.get(_LET_GO, None)
    path = _made[name] = f"{shared_dir(spark)}/{name}"
    try:
        spark.conf.set(_LET_GO, "true")
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(_LET_GO) if before is None else spark.conf.set(_LET_GO, before)
    return spark.read.parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the tables made by written() that df reads, when no later plan reads them; others stay."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()} & _made.keys():
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop(name))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so no other column's name can clash; null texts become empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def length_updated(df: DataFrame, text_col: str, length_col: str | None) -> DataFrame:
    """df with length_col brought up to date with the text, if there is such a column and it holds whole numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    if isinstance(kinds.get(length_col), IntegralType):
        return df.withColumn(length_col, F.length(text_col).cast(kinds[length_col]))
    return df


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WHITE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def free_name(name: str, taken) -> str:
    """name, with as many underscores as it takes to be none of the taken ones, whatever their case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def groups_of(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about `most` bytes together; a longer one is a run by itself."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if size:
        yield first, len(texts)


def word_hashes(text: bytes, most: int = 1 << 20) -> np.ndarray:
    """Words.hash of one text; long ones are taken a bounded number of bytes at a time, cut at white space."""
    if len(text) <= most:
        return Words([text]).hash
    out, at = [], 0
    while at < len(text):
        cut = _WHITE_BYTE.search(text, at + most)
        end = cut.end() if cut else len(text)
        out.append(Words([text[at:end]]).hash)
        at = end
    return np.concatenate(out)


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every run of k word hashes, in order."""
    n = max(words.size - k + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n])
    return out


class Words:
    """Hashes of the words of many texts at once.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.  hash: 64 bits of each word;
    first, last: byte span within the joined texts; doc: index of the text; of[i]:of[i+1] are text i's words.
    """

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        n = joined.size
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        white = _IS_WHITE[joined]
        edge = np.diff(white.astype(np.int8), prepend=1)
        self.first = np.flatnonzero(edge == -1)
        self.last = np.flatnonzero(edge == 1) if self.first.size else self.first[:0]
        if self.last.size > self.first.size:
            self.last = self.last[self.last > 0]
        with np.errstate(over="ignore"):
            terms = _BYTE_HASH[_LOWER[joined]] * powers(_ODD, n)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            h = (total[self.last] - total[self.first]) * powers(_INVERSE, n)[self.first]
            self.hash = mix64(h ^ (self.last - self.first).astype(np.uint64))
        self.of = np.searchsorted(self.first, self.base)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of every run of k words within a text, in order, and their offsets by text."""
        sizes = np.maximum(np.diff(self.of) - k + 1, 0)
        of = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(of[-1]) + np.repeat(self.of[:-1] - of[:-1], sizes)
        out = np.zeros(at.size, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + self.hash[at + j])
        return out, of
