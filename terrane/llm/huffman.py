"""Token ids in canonical length-limited Huffman code.

Code lengths come from the counts of all ids by package-merge under a limit; the code is canonical, so the lengths alone
define it.  A table of files has one row with them (block -1); the others are independent blocks of whole documents: code
bits, bit offsets every CHECKPOINT ids, and the documents' ids and sizes.  So whoever has the files can read them.  Decoding
looks up the longest code's bits at a time in a table and runs all of a block's stretches between checkpoints side by side.
The driver only gets counts by id (bounded by the vocabulary) and totals by part.

Null and empty texts are one end id.  Rows with one doc_id, or none (they come first), are ordered by their ids.  An empty
table gives no rows.  Other columns take no part, whatever their names.  A text is in one block, whole, whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from terrane.llm.bpe import library_ids
from terrane.llm.common import remove, two, written

LIMIT, CHECKPOINT, BLOCK_IDS = 18, 512, 262_144


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The length of each symbol's code (0: unused) by package-merge; counts decide, ties by symbol."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(counts.size, np.uint8)
    if used.size < 2:
        lengths[used] = 1
        return lengths
    if used.size > 1 << limit or limit > 24:
        raise ValueError(f"{used.size} different ids and codes of {limit} bits at most: give a limit that can tell them apart, 24 or less")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    n = used.size
    merged, kinds = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = merged.size // 2 * 2
        packages = merged[:m:2] + merged[1:m:2]
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        kinds.append(order < n)
    take = 2 * n - 2
    for kind in reversed(kinds):
        singles = int(kind[:take].sum())
        lengths[used[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: by length, then symbol, counting up."""
    codes, code, last = np.zeros(lengths.size, np.int64), 0, 0
    order = np.lexsort((np.arange(lengths.size), lengths))
    for s in order[np.count_nonzero(lengths == 0) :].tolist():
        code <<= int(lengths[s]) - last
        codes[s], last = code, int(lengths[s])
        code += 1
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every CHECKPOINT-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    # Each code within the 64 bits that begin at its 32-bit word; codes share no bits, so sums put them together.
    wide = codes[ids].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
    word, n = start >> 5, (int(end[-1]) >> 5) + 2 if ids.size else 0
    out = np.bincount(word, wide >> np.uint64(32), n) + np.bincount(word + 1, wide & np.uint64(0xFFFFFFFF), n)
    return out.astype(">u4").tobytes()[: int(end[-1]) + 7 >> 3 if ids.size else 0], start[::CHECKPOINT]


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) for every so many next bits, and how many: those of the longest code."""
    limit = max(int(lengths.max(initial=0)), 1)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (limit - lengths[used].astype(np.int64)))]
    spread = np.int64(1) << (limit - lengths[used].astype(np.int64))
    symbol = np.zeros(1 << limit, np.uint32)
    symbol[: spread.sum()] = np.repeat(used, spread)
    return symbol, lengths[symbol].astype(np.int64), limit


def decode_bits(data: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    symbol, length, limit = table
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.int64)
    at = offsets.astype(np.int64).copy()
    out = np.zeros((at.size, CHECKPOINT), np.uint32)
    last = raw.size - 4
    for j in range(CHECKPOINT if n >= CHECKPOINT else n):
        byte = np.minimum(at >> 3, last)
        window = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
        key = window >> (32 - limit - (at & 7)) & (1 << limit) - 1
        out[:, j] = symbol[key]
        at += length[key]
    return out.ravel()[:n]


def _squeezed(ids: np.ndarray) -> bytes:
    """Ids as bytes: all lowest ones, then the next ones, as many as the largest id has, compressed."""
    wide = max(1, int(ids.max(initial=0)).bit_length() + 7 >> 3)
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T).tobytes())


def _loosened(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((flat.shape[1], 4), np.uint8)
    out[:, : data[0]] = flat.T
    return out.view("<u4").ravel()


def token_table(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (compressed, with the end id); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end_id], "<u4")
        for batch in batches:
            ids = [_squeezed(np.append(x, last)) for x in library_ids(path, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return written(two(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary"), "tokens")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Counts by id over all documents; each partition sends one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(0, np.int64), []

        def add() -> None:
            nonlocal total, held
            c = np.bincount(np.concatenate([*held, np.zeros(0, "<u4")]), minlength=total.size)
            c[: total.size] += total
            total, held = c, []

        for batch in batches:
            for x in batch.column("ids").to_pylist():
                held.append(_loosened(x))
                if len(held) > 500:
                    add()
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


FILE = "part int, block int, start long, doc_id array<long>, n array<long>, offsets array<long>, bits binary"


def write_ids(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The files as a table.  Blocks are in ascending doc_id order; start counts from the part's first id."""
    tokens = token_table(df, path, end_id, id_col, text_col)
    lengths = code_lengths(count_ids(tokens), limit)
    codes = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, docs, parts, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            bits, offsets = encode_bits(np.concatenate(parts), lengths, codes)
            values = [part], [block], [start], [docs], [[p.size for p in parts]], [offsets], [bits]
            longs = pa.list_(pa.int64())
            kinds = pa.int32(), pa.int32(), pa.int64(), longs, longs, longs, pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "start", "doc_id", "n", "offsets", "bits"])

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                parts.append(_loosened(x))
                held += parts[-1].size
                if held >= BLOCK_IDS:
                    yield out()
                    block, start, docs, parts, held = block + 1, start + held, [], [], 0
        if docs:
            yield out()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    head = df.sparkSession.createDataFrame([(-1, -1, 0, [], [], [], bytearray(zstandard.ZstdCompressor().compress(lengths.tobytes())))], FILE)
    files = written(ordered.mapInArrow(run, FILE).union(head), "huffman")
    remove(tokens)
    return files


def read_ids(files: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids, or with digest ids_crc32, decoded from a table of files that write_ids() made."""
    lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(files.where("block < 0").first()["bits"])), np.uint8)
    files = files.where("block >= 0")
    last = files.groupBy("part").agg(F.max(F.col("start") + F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).collect()
    before, total = {}, 0
    for r in sorted(last, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]
    codes = canonical(lengths)
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, codes)
        for batch in batches:
            for row in batch.to_pylist():
                size = np.array(row["n"], np.int64)
                ids = decode_bits(row["bits"], np.array(row["offsets"], np.int64), int(size.sum()), table).astype("<u4")
                end = np.cumsum(size)
                each = [ids[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
                start = end - size + row["start"] + before[row["part"]]
                value = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(start), pa.array(size), value], names)

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")
