"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every suffix of the test items.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII.  A task takes its documents in shards
of about SHARD bytes, numbers their words by the items' vocabulary and sorts the suffixes of each shard; a word that no item
has ends a suffix, as no match goes across it.  Each suffix of each item is then found by binary search, word by word.

Defined results: null texts have no words; rows of equal ids are judged each by itself; an item of fewer words than a window
is one window, one without words is never found; equal items are all found; items without an id go by the empty name, and
items of equal id count once; empty tables give empty results or no finds.  Texts are taken whole, a longer one than a shard
is a shard by itself.  Other columns of either table are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from terrane.llm.common import as_bytes, groups_of, remove, written

#: Words of a window; bytes of training text under one suffix array; bytes of items held by every task at once, and of a piece of one.
WINDOW, SHARD, BLOCK, PIECE = 10, 8 << 20, 16 << 20, 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x30] = _FOLD[0x3A:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0
_FOLD[0x41:0x5B] += 32


def words_of(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts in a row, and how many each text has."""
    folded = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = folded > 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), first.size, [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])])
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.diff(np.searchsorted(first, base))


def spread(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with a zero after each text's, and where each text begins (and the last one ends)."""
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.zeros(starts[-1], np.int64)
    out[np.arange(ids.size) + np.repeat(np.arange(counts.size), counts)] = ids
    return out, starts


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions of all ids but zeros, by order of what follows them up to the next zero; equal ones by position.

    The last id is zero.  Doubling: what is sorted by its first `depth` words is sorted by twice as many from the ranks of its
    second half; only groups that still hold unlike suffixes are sorted again.
    """
    order = np.flatnonzero(ids)
    if not order.size:
        return order
    zeros = np.flatnonzero(ids == 0)
    bits = int(ids.max()).bit_length()
    depth = max(1, min(63 // bits, 8))
    key, on = ids[order], np.ones(order.size, bool)
    for j in range(1, depth):
        at = order + j
        following = ids[np.minimum(at, ids.size - 1)]
        on &= following > 0
        key = key << bits | np.where(on, following, 0)
    by_key = np.argsort(key, kind="stable")
    order, key = order[by_key], key[by_key]
    left = zeros[np.searchsorted(zeros, order)] - order
    start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    rank = np.zeros(ids.size + 1, np.int64)
    while True:
        sizes = np.diff(start, append=order.size)
        rank[order] = np.repeat(start, sizes) + 1
        open_ = (sizes > 1) & (np.maximum.reduceat(left, start) > depth)
        if not open_.any():
            return order
        again = np.repeat(open_, sizes)
        group, members = np.repeat(start[open_], sizes[open_]), order[again]
        second = rank[members + depth]
        by = np.lexsort((members, second, group))
        order[again], second = members[by], second[by]
        left[again] = left[again][by]
        new = np.zeros(order.size, bool)
        new[start] = True
        within = np.flatnonzero(again)[1:][(np.diff(second) != 0) & (np.diff(group) == 0)]
        new[within] = True
        start = np.flatnonzero(new)
        depth *= 2


def _bound(ids: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, depth: int, after: bool) -> np.ndarray:
    """First places between lo and hi whose word at this depth isn't below the one wanted, or (after) is above it."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        word = ids[np.minimum(sa[np.minimum(mid, sa.size - 1)] + depth, ids.size - 1)]  # ranges already closed may lie anywhere
        up = (lo < hi) & ((word <= wanted) if after else (word < wanted))
        down = (lo < hi) & ~up
        lo[up], hi[down] = mid[up] + 1, mid[down]
    return lo


def search(ids: np.ndarray, sa: np.ndarray, query: np.ndarray, starts: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest match of each suffix of query, of most[i] words at the most: its length, and the range of sa that has it."""
    n = starts.size
    length, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, sa.size, np.int64)
    active, depth = np.flatnonzero(most > 0) if sa.size else np.zeros(0, np.int64), 0
    while active.size:
        wanted = query[starts[active] + depth]
        a = _bound(ids, sa, lo[active], hi[active], wanted, depth, False)
        b = _bound(ids, sa, a, hi[active], wanted, depth, True)
        found = b > a
        active = active[found]
        lo[active], hi[active], length[active] = a[found], b[found], depth + 1
        depth += 1
        active = active[most[active] > depth]
    return length, lo, hi


class Items:
    """A block of test items: their vocabulary, their words as one query, and their distinct windows."""

    def __init__(self, names: list[str], texts: list[bytes], window: int = WINDOW):
        words, counts = words_of(texts)
        coded = words.dictionary_encode()
        self.names, self.vocabulary = names, coded.dictionary
        self.query, starts = spread(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, counts)
        self.suffixes = np.flatnonzero(self.query)
        self.item = np.searchsorted(starts, self.suffixes, "right") - 1
        #: Words from each suffix to its item's end, and of a window of that item.
        self.left = starts[self.item + 1] - 1 - self.suffixes
        size = np.minimum(counts, window)[self.item]
        whole = np.flatnonzero(self.left >= size)
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(self.query[s : s + k].tobytes(), len(seen)) for s, k in zip(self.suffixes[whole], size[whole], strict=True)], np.int64)
        # One suffix for each distinct window, and the items that hold it.
        self.window_at = np.full(len(seen), -1, np.int64)
        self.window_at[of[::-1]] = self.suffixes[whole][::-1]
        self.window_size = np.zeros(len(seen), np.int64)
        self.window_size[of] = size[whole]
        holders = np.unique(np.stack([of, self.item[whole]], 1), axis=0) if of.size else np.zeros((0, 2), np.int64)
        self.holder, self.holders_of = holders[:, 1], np.searchsorted(holders[:, 0], np.arange(len(seen) + 1))

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of texts as numbers of the items' vocabulary, from 1; where each text begins; how many words it has."""
        words, counts = words_of(texts)
        ids = pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return *spread(ids, counts), counts

    def leaks(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text its words, the spans of words inside any window's occurrence, and the items with such windows."""
        ids, starts, counts = self.numbered(texts)
        sa = suffix_array(ids)
        length, lo, hi = search(ids, sa, self.query, self.window_at, self.window_size)
        found = np.flatnonzero(length == self.window_size)
        sizes = (hi - lo)[found]
        ends = np.cumsum(sizes)
        at = sa[np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes) + np.repeat(lo[found], sizes)]
        window = np.repeat(found, sizes)
        depth = np.bincount(at, minlength=ids.size + 1) - np.bincount(at + self.window_size[window], minlength=ids.size + 1)
        edges = np.flatnonzero(np.diff((np.cumsum(depth) > 0).view(np.int8), prepend=0))
        text = np.searchsorted(starts, edges[::2], "right") - 1
        spans = np.stack([edges[::2] - starts[text], edges[1::2] - starts[text]], 1)
        pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, window], 1), axis=0) if at.size else np.zeros((0, 2), np.int64)
        each, each_pair = np.searchsorted(text, np.arange(len(texts) + 1)), np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
        for i, n in enumerate(counts.tolist()):
            own = pairs[each_pair[i] : each_pair[i + 1], 1]
            names = {self.names[k] for w in own for k in self.holder[self.holders_of[w] : self.holders_of[w + 1]]}
            yield n, [tuple(s) for s in spans[each[i] : each[i + 1]].tolist()], sorted(names)

    def longest(self, texts: list[bytes], rank: np.ndarray, least: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(item, word of the item, words matched, text, word of the text) for each suffix matched over at least so many words.

        Of several texts the one of the least rank, then the first place in it.
        """
        ids, starts, _ = self.numbered(texts)
        sa = suffix_array(ids)
        length, lo, hi = search(ids, sa, self.query, self.suffixes, self.left)
        first = np.searchsorted(self.item, np.arange(len(self.names)))
        for s in np.flatnonzero(length >= least).tolist():
            at = sa[lo[s] : hi[s]]
            at = at[np.argmin(rank[np.searchsorted(starts, at, "right") - 1] * np.int64(ids.size) + at)]
            text = int(np.searchsorted(starts, at, "right")) - 1
            yield self.names[self.item[s]], s - int(first[self.item[s]]), int(length[s]), text, int(at - starts[text])


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item and text: distinct items, in pieces of PIECE bytes that repeat a window's words but one, so that no window is lost."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if len(text) <= PIECE:
                    names, texts = [*names, name], [*texts, text]
                    continue
                words = words_of([text])[0].to_pylist()
                first = end = 0
                while first == 0 or end < len(words):
                    first, size = max(end - window + 1, 0), 0
                    end = first
                    while end < len(words) and (size <= PIECE or end < first + window):
                        size, end = size + len(words[end]) + 1, end + 1
                    names, texts = [*names, name], [*texts, b" ".join(words[first:end])]
                    if end == len(words):
                        break
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["item", "text"])

    return rows.mapInArrow(cut, "item string, text string")


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """The items in blocks of at most so many bytes (or one piece): one block, if all fit, else as many as their hash needs."""
    table = written(_pieces(items, id_col, text_col, window), "items")
    size, n = F.sum(F.octet_length("text") + 64), 1
    block = lambda n: F.pmod(F.xxhash64("item", "text"), F.lit(n))
    while n < 1 << 20 and (table.groupBy(block(n).alias("b")).agg(size.alias("s")).agg(F.max("s")).first()[0] or 0) > max(most, PIECE + 64):
        n *= 2
    for b in range(n):
        rows = table.where(block(n) == b).orderBy("item", "text").collect()
        yield [r["item"] for r in rows], [r["text"].encode() for r in rows]
    remove(table)


_ARROW = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]


def _united(a: list[dict] | None, b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order; spans that touch become one."""
    out: list[list[int]] = []
    for start, end in sorted([*((s["start"], s["end"]) for s in a or ()), *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def _marked(rows: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, block: int) -> DataFrame:
    """rows (doc, text) with n_words, spans of words inside windows, and items: block after block, each adding to the one before.

    All items in one block make one pass without a shuffle; further blocks read the table that the one before wrote.
    """
    out, tables = rows.withColumns({"spans": F.lit(None).cast("array<struct<start:long,end:long>>"), "items": F.lit(None).cast("array<string>")}), []
    schema = rows.schema.add("n_words", "long").add("spans", out.schema["spans"].dataType).add("items", out.schema["items"].dataType)
    for k, (names, texts) in enumerate(_blocks(items, item_col, item_text_col, window, block)):
        shared = rows.sparkSession.sparkContext.broadcast((names, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = Items(*shared.value, window)
            for batch in batches:
                raw = as_bytes(batch.column("text"))
                spans, items, found = batch.column("spans").to_pylist(), batch.column("items").to_pylist(), []
                for first, end in groups_of(raw, SHARD):
                    for i, (n, new, names) in enumerate(of.leaks(raw[first:end]), first):
                        found.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in _united(spans[i], new)], "items": sorted({*(items[i] or ()), *names})})
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), *pa.RecordBatch.from_pylist(found, pa.schema(_ARROW)).columns], schema.names)

        if k:
            tables.append(written(out, "leaks"))
            if k > 1:
                remove(tables[-2])
            out = tables[-1].select("doc", "text", "spans", "items")
        out = out.mapInArrow(run, schema)
    return out.drop("text")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (start, end by words) and items (sorted ids) of each row of docs."""
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _marked(rows, items, item_col, item_text_col, window, block).select("doc.doc_id", "n_words", "spans", "items")


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns."""
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _marked(rows, items, item_col, item_text_col, window, block).where(F.size("items") == 0).select("doc.*")


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """item, position, length, doc_id, at: the longest verbatim match of each item's suffix over all shards, and where it is.

    Suffixes matched over fewer than `least` words have no row.  Ties: the smallest doc_id, null first, then the smallest place.
    Items of over PIECE bytes are cut into pieces, and their positions count from the piece's beginning.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = None
    for names, texts in _blocks(items, item_col, item_text_col, least, block):
        shared = two.sparkSession.sparkContext.broadcast((names, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = Items(*shared.value, least)
            for batch in batches:
                raw, ids, out = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), []
                rank = np.argsort(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)))
                for first, end in groups_of(raw, SHARD):
                    out += [{"item": item, "position": p, "length": n, "doc_id": ids[first + i], "at": at} for item, p, n, i, at in of.longest(raw[first:end], rank[first:end], least)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("item", pa.string()), ("position", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())]))

        rows = two.mapInArrow(run, "item string, position long, length long, doc_id long, at long")
        best = rows.groupBy("item", "position").agg(F.min(F.struct(-F.col("length"), "doc_id", "at")).alias("b"))
        part = best.select("item", "position", (-F.col("b.col1")).alias("length"), "b.doc_id", "b.at")
        found = part if found is None else found.unionByName(part)
    return found
