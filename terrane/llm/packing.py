"""Sum-of-squares online packing of token ids into sequences.

A document's ids are cut at the sequence length; each remaining piece goes to the open sequence whose fill level gives the
smallest sum of squared counts of partially filled sequences, level 0 being a new one.  counts[level] is the level array.
Each partition packs its own documents in the order they come, so nothing is shuffled.  At a partition's end the pieces of
its open sequences are laid end to end and cut anew into full sequences; the last rest is cut into powers of two, which
need no padding.

Null and empty texts are one end id.  Repeated rows are packed each by itself.  An empty table gives an empty result.  Other
columns take no part, whatever their names.  Texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terrane.llm.bpe import library_ids
from terrane.llm.common import two

#: (doc_id, start, ids, doc_tokens)
Piece = tuple[int, int, np.ndarray, int]


class Packer:
    def __init__(self, length: int = 1024):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(length)]

    def level(self, size: int) -> int:
        """The fill level to put size ids on; ties go to the fuller one."""
        c = self.counts
        cost = 1 + 2 * c[size:]
        cost[-1] = 0  # a full sequence is no longer open
        leave = 1 - 2 * c[: self.length - size + 1]
        leave[0] = 0
        total = np.where(c[: self.length - size + 1] > 0, cost + leave, np.iinfo(np.int64).max)
        total[0] = cost[0]
        return self.length - size - int(np.argmin(total[::-1]))

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Takes one document; gives the sequences that are now full."""
        n = ids.size
        for start in range(0, n, self.length):
            piece = (doc, start, ids[start : start + self.length], n)
            size = piece[2].size
            if size == self.length:
                yield [piece]
                continue
            at = self.level(size)
            held = []
            if at:
                held = self.open[at].pop()
                self.counts[at] -= 1
            held.append(piece)
            if at + size == self.length:
                yield held
            else:
                self.open[at + size].append(held)
                self.counts[at + size] += 1

    def close(self) -> Iterator[list[Piece]]:
        """The open sequences' pieces, cut anew: full sequences, then powers of two."""
        rest = [p for bins in self.open for held in bins for p in held]
        left = sum(p[2].size for p in rest)
        self.__init__(self.length)
        room, held = 0, []
        for doc, start, ids, n in rest:
            while ids.size:
                if not room:
                    room = min(self.length, 1 << (left.bit_length() - 1))
                take = ids[:room]
                held.append((doc, start, take, n))
                start, ids = start + take.size, ids[room:]
                room -= take.size
                left -= take.size
                if not room:
                    yield held
                    held = []


def pack(df: DataFrame, path: str, end_id: int = 0, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, rows = Packer(length), TaskContext.get().partitionId() << 40, []

        def put(sequence: list[Piece]) -> None:
            nonlocal number
            at = 0
            for doc, start, ids, n in sequence:
                rows.append((doc, start, ids.size, zlib.crc32(ids.tobytes()), n, number, at) + ((ids.astype(np.int32),) if with_ids else ()))
                at += ids.size
            number += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for doc, ids in zip(docs, library_ids(path, batch.column("text")), strict=True):
                for sequence in packer.add(doc, np.append(ids, np.array([end_id], "<u4"))):
                    put(sequence)
                if len(rows) > 5000:
                    yield batch_of()
        for sequence in packer.close():
            put(sequence)
        yield batch_of()

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return two(df, id_col, text_col).mapInArrow(run, schema)
