"""Scores of texts by online logistic mixing of hashed-context bit predictors.

A text is its words, A-Z in lower case, each with one space after it, then one end byte.  Each byte is coded as eight binary
choices.  A predictor keeps for each hashed context, which the choices already made in the byte belong to, how often one and
zero followed, in a table of SLOTS slots.  Contexts are the last two, three, four and six bytes of
the word, as far as it goes.  The choices' log-odds are summed by weights that a gate selects: how often the second and the last
context were seen.  Tables hold all distinct words of training texts, part by part and then summed; weights are learnt online
in each part on all of them, in order of their hashes, and averaged gate by gate, weighted by the gate's choices; parts go by
hash, and their number by the texts' bytes.  A training word's own place in the
tables is taken away, in learning and in scoring.

That spells any word.  Three more predictions are of whole words: their counts in all training texts, those within the class,
and those in the text so far.  The class at a word is that of the last very frequent word before it: such words are classed
by the documents that they share, so classes tell languages and registers apart.  The four are added by weights that a second gate selects (how far the text is, whether its class
is known), learnt by expectation-maximisation on all training texts: their predictions' ratios are counted, to half powers of two,
and the counts summed.  So scores are those of the table, however it is cut into partitions.  While a text is
scored, these weights are refined after each chunk of CHUNK words by how well each prediction did.  The score is the log10
probability of the text; such probabilities sum to one over all texts.  In training texts each word's own count is
taken away, in learning and in scoring.

The tables' size is fixed, so they may be broadcast: 4 * SLOTS * 4 bytes.  What fills them, and the word counts, grow with the
corpus.  The base score is that of single words, told apart by 64-bit hashes.  Each block's distinct words are dealt to parts by
hash, a row a block and part, so equal ones meet; there they are counted and spelt, each once, and sent back by place.

Null and empty texts have the end token alone.  Repeated rows of one id get equal scores.  A null id counts as the empty text in
choosing what is held out.  Without training texts all counts are zero and each choice has even odds.  An empty table gives no
rows.  Other columns take no part, whatever their names.  A text is in one block, whole, whatever its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from terrane.llm.common import as_bytes, mix64, powers, remove, two, written

#: Bytes of text in one block; a longer text is a block by itself.
BLOCK_BYTES = 6_000_000
#: Bytes of text whose distinct words make a part, on the average.
PART_BYTES = 16_000_000
END, GAP = 10, 32
BITS = 22
SLOTS, PIECE = 1 << BITS, 1 << 16
#: Bytes of the word before that a predictor's context has.
ORDERS = (2, 3, 4, 6)
PREDICTORS = len(ORDERS)
#: Frequent words that have a class, and how many classes there are at most.
FREQUENT, CLASSES, ALIKE = 64, 8, 0.35
_LEAST = 0.3
_LEVELS = np.array([1, 3, 12, 100, 2000], np.float32)
GATES = (_LEVELS.size + 1) ** 2
#: By count: the logarithm, with nothing or one taken away, and the level.
_LOG = [np.log(np.maximum(np.arange(65536) - own, 0) + _LEAST).astype(np.float32) for own in (0, 1)]
_LEVEL = np.searchsorted(_LEVELS, np.arange(131072), side="right").astype(np.int16)
#: How far a text is, in words, for the weights of the four predictions: words, words of the class, spelling, the text so far.
_FAR = np.array([1, 30, 150, 600, 2500])
FAR_GATES, PREDICTIONS = 2 * (_FAR.size + 1), 4
#: Ratios of predictions that are told apart when their weights are learnt.
RATIOS = 32
#: Words after which a text's weights are refined, and how many words' worth of evidence they start with.
CHUNK, PATIENCE = 64, 40.0
#: Distinct tokens whose choices are handled at once.
STEP = 4000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


#: Bytes of text hashed at once.
_RUN = 1 << 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(_ODD, _RUN), powers(_INVERSE, _RUN)


def stream(text: bytes) -> bytes:
    words = text.lower().split()
    return b" ".join(words) + b" \n" if words else b"\n"


class Tokens:
    """The tokens of many streams.  first, size: their bytes in buf; hash: of their bytes; doc: the stream of each;
    code, distinct: which of the distinct tokens each is, and where each of those occurs first."""

    def __init__(self, streams: list[bytes]):
        self.buf = np.frombuffer(b"".join(streams), np.uint8)
        edge = np.flatnonzero((self.buf == GAP) | (self.buf == END)) + 1
        self.size = np.diff(edge, prepend=0)
        self.first = edge - self.size
        self.docs = len(streams)
        ends = np.searchsorted(edge, np.cumsum([0, *(len(s) for s in streams)]), side="right")
        self.doc = np.repeat(np.arange(self.docs), np.diff(ends))
        found = []
        for a, b in self.runs():  # a bounded number of bytes at a time
            part = self.buf[self.first[a] : edge[b - 1]]
            start = self.first[a:b] - self.first[a]
            with np.errstate(over="ignore"):
                up, down = _powers() if part.size <= _RUN else (powers(_ODD, part.size), powers(_INVERSE, part.size))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_HASH[part] * up[: part.size], dtype=np.uint64)])
                found.append(mix64((total[start + self.size[a:b]] - total[start]) * down[start]))
        self.hash = np.concatenate([*found, np.zeros(0, np.uint64)])
        self.code, kinds = pd.factorize(self.hash)
        self.distinct = np.full(kinds.size, -1)
        self.distinct[self.code[::-1]] = np.arange(self.code.size)[::-1]

    def spelt_out(self, which: np.ndarray) -> bytes:
        """The bytes of these tokens, one after another."""
        size = self.size[which]
        return self.buf[np.repeat(self.first[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()

    def runs(self, most: int = _RUN) -> Iterator[tuple[int, int]]:
        a = 0
        while a < self.first.size:
            b = max(int(np.searchsorted(self.first, self.first[a] + most)), a + 1)
            yield a, b
            a = b

    def classes(self, frequent: dict[int, int]) -> np.ndarray:
        """The class of the last frequent word before each token in its stream; 0: none."""
        of = np.array([frequent.get(h, 0) for h in self.hash[self.distinct].tolist()], np.int64)[self.code]
        last = np.maximum.accumulate(np.where(of > 0, np.arange(of.size), -1))
        last = np.concatenate([[-1], last[:-1]])
        return np.where((last >= 0) & (self.doc[last] == self.doc), of[last], 0)


def paired(t: Tokens, classes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(pair of each token, pairs): a pair is a distinct token's number times (CLASSES + 1), and the class."""
    return pd.factorize(t.code * (CLASSES + 1) + t.classes(classes))


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on, compressed."""
    return _zip(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(_unzip(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel()


def is_held_out(doc) -> bool:
    """By the id's text alone; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


BLOCK = "block long, part int, doc_id array<long>, held array<boolean>, size array<long>, streams binary, words binary, class binary, n binary, place binary"
_BLOCK = ["block", "part", "doc_id", "held", "size", "streams", "words", "class", "n", "place"]
_KINDS = pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 5


def _rows(cells: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds, strict=True)], names)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bool], list[bytes]]]:
    """(ids, held out, streams) of runs of texts of about `most` bytes."""
    ids, held, streams, size = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            ids.append(doc)
            held.append(is_held_out(doc))
            streams.append(stream(text))
            size += len(streams[-1])
            if size >= most:
                yield ids, held, streams
                ids, held, streams, size = [], [], [], 0
    if ids:
        yield ids, held, streams


def _blocks(df: DataFrame, classes: dict[int, int], block_bytes: int, parts: int) -> DataFrame:
    """Rows of BLOCK: a block's texts (part -1), and for each part its distinct words with their class, how often training
    texts have them, and their places among the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (ids, held, streams) in enumerate(_gathered(batches, block_bytes)):
            number, t, learns = (TaskContext.get().partitionId() << 32) + k, Tokens(streams), ~np.array(held, bool)
            pair, pairs = paired(t, classes)
            n, words = np.bincount(pair[learns[t.doc]], minlength=pairs.size), t.hash[t.distinct[pairs // (CLASSES + 1)]]
            part = words % np.uint64(parts)
            cells = [(number, -1, ids, held, [len(s) for s in streams], _zip(b"".join(streams)), None, None, None, None)]
            for j in np.unique(part).tolist():
                mine = np.flatnonzero(part == j)
                cells.append((number, j, None, None, None, None, _zip(t.spelt_out(t.distinct[pairs[mine] // (CLASSES + 1)])), _planes(pairs[mine] % (CLASSES + 1)), _planes(n[mine]), _planes(np.diff(mine, prepend=0))))
            yield _rows(cells, _BLOCK, _KINDS)

    return df.mapInArrow(run, BLOCK)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], Tokens, np.ndarray]]:
    """(part, its rows, their words, training count of each distinct one) for rows in order of parts."""
    now, held = None, []

    def whole() -> tuple[int, list[dict], Tokens, np.ndarray]:
        t = Tokens([_unzip(r["words"]) for r in held])
        return now, held, t, np.bincount(t.code, np.concatenate([_from_planes(r["n"]) for r in held]), t.distinct.size).astype(np.int64)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now and held:
                yield whole()
                held = []
            now = row["part"]
            held.append(row)
    if held:
        yield whole()


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.where("part >= 0").select("block", "part", "words", "class", "n", "place").repartition("part").sortWithinPartitions("part", "block")


def _counted(dealt: DataFrame, model, weights: np.ndarray) -> DataFrame:
    """block, part, place, n, in_class, spelt: for a block's words of the part their training counts over all blocks, at all
    and in the class, and how likely they are spelt so (packed).  Each part has one row more, of block -1: its sums of counts by
    class and the number of its words."""
    names = ["block", "part", "place", "n", "in_class", "spelt", "total", "words"]
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held, t, of_word in _parts(batches):
            kind, n = (np.concatenate([_from_planes(r[c]) for r in held]).astype(np.int64) for c in ("class", "n"))
            both, pairs = pd.factorize(t.code * (CLASSES + 1) + kind)
            of_pair, spelt = np.bincount(both, n, pairs.size), np.zeros(of_word.size, np.float32)
            for own in (0, 1):
                mine = np.flatnonzero((of_word > 0) == own)
                spelt[mine] = spelling(t, t.distinct[mine], model.value, weights, own)
            yield _rows([(-1, part, None, None, None, None, np.bincount(kind, n, CLASSES + 1).astype(np.int64), int((of_word > 0).sum()))], names, kinds)
            edge = np.concatenate([[0], np.cumsum(np.bincount(t.doc, minlength=t.docs))]).tolist()
            for r, a, b in zip(held, edge[:-1], edge[1:], strict=True):
                yield _rows([(r["block"], part, r["place"], _planes(of_word[t.code[a:b]]), _planes(of_pair[both[a:b]]), _zip(spelt[t.code[a:b]].tobytes()), None, None)], names, kinds)

    return dealt.mapInArrow(run, "block long, part int, place binary, n binary, in_class binary, spelt binary, total array<long>, words long")


def _streams(row: dict) -> list[bytes]:
    data, at = _unzip(row["streams"]), np.cumsum([0, *row["size"]]).tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _frequent(df: DataFrame, most: int = 4_000_000) -> list[int]:
    """Hashes of the FREQUENT most frequent words of all training texts, ties by hash; the end token is none of them."""
    end = int(Tokens([b"\n"]).hash[:1].view(np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, streams in _gathered(batches, most):
            t = Tokens([s for s, out in zip(streams, held, strict=True) if not out])
            yield pa.RecordBatch.from_arrays([pa.array(t.hash[t.distinct].view(np.int64)), pa.array(np.bincount(t.code, minlength=t.distinct.size))], ["a", "n"])

    counts = df.mapInArrow(run, "a long, n long").where(F.col("a") != end).groupBy("a").agg(F.sum("n").alias("n"))
    top = written(counts.orderBy(F.desc("n"), "a").limit(FREQUENT), "mixing-frequent")
    found = [r["a"] for r in top.orderBy(F.desc("n"), "a").collect()]
    remove(top)
    return found


def _shared_by_documents(df: DataFrame, frequent: list[int], most: int = 4_000_000) -> DataFrame:
    """a, b, n: training documents that hold both of two frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.array(frequent, np.int64)
        for _, held, streams in _gathered(batches, most):
            t = Tokens([s for s, out in zip(streams, held, strict=True) if not out])
            place = {int(h): k for k, h in enumerate(words.view(np.uint64))}
            rank = np.array([place.get(h, -1) for h in t.hash[t.distinct].tolist()], np.int64)
            some = rank[t.code] >= 0
            has = np.zeros((t.docs, words.size), np.float32)
            has[t.doc[some], rank[t.code][some]] = 1
            both = (has.T @ has).astype(np.int64)
            a, b = np.nonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(words[a]), pa.array(words[b]), pa.array(both[a, b])], ["a", "b", "n"])

    return df.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def word_classes(shared: DataFrame) -> dict[int, int]:
    """Class (from 1) by the hash of each of the FREQUENT words in most documents; the driver gets FREQUENT ** 2 numbers.

    Starting from single words, the two classes that share most documents on the average are put together, as long as they
    share ALIKE of the rarer one's or there are too many.  The end token belongs to none.
    """
    end = int(Tokens([b"\n"]).hash[:1].view(np.int64)[0])
    top = [r["a"] for r in shared.where("a = b").where(F.col("a") != end).orderBy(F.desc("n"), "a").limit(FREQUENT).collect()]
    place = {a: i for i, a in enumerate(top)}
    n = np.zeros((len(top), len(top)))
    for r in shared.where(F.col("a").isin(top) & F.col("b").isin(top)).collect() if top else []:
        n[place[r["a"]], place[r["b"]]] = r["n"]
    alike = n / np.maximum(np.minimum.outer(n.diagonal(), n.diagonal()), 1)
    groups = [[i] for i in range(len(top))]
    while len(groups) > 1:
        best = max((float(alike[np.ix_(g, h)].mean()), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups[:i]))
        if best[0] < ALIKE and len(groups) <= CLASSES:
            break
        groups[-best[2]] += groups.pop(-best[1])
    return {int(np.int64(top[i]).view(np.uint64)): k for k, g in enumerate(groups, 1) for i in g}


class Choices:
    """The binary choices of some tokens.  slot[k]: predictor k's slots, a row of eight a byte; bit: what came;
    token: whose byte."""

    def __init__(self, t: Tokens, which: np.ndarray, orders: tuple[int, ...] = ORDERS):
        first, size = t.first[which], t.size[which]
        begin = np.cumsum(size) - size
        self.token = np.repeat(np.arange(which.size), size)
        buf = t.buf[np.arange(size.sum()) + (first - begin)[self.token]]
        start = begin[self.token]
        at, wide = np.arange(buf.size), buf.astype(np.uint64)
        with np.errstate(over="ignore"):
            last = [np.zeros(buf.size, np.uint64)]
            for k in range(1, max(orders) + 1):
                there = at - k >= start
                last.append(last[-1] | np.where(there, wide[np.maximum(at - k, 0)] + np.uint64(1), np.uint64(0)) << np.uint64(9 * (k - 1)))
            contexts = [mix64(last[k] * np.uint64(8) + np.uint64(k)) for k in orders]
            so_far = (np.uint64(256) | wide)[:, None] >> np.arange(8, 0, -1).astype(np.uint64)  # a one, then the choices before
            self.slot = [((c[:, None] ^ so_far * _ODD) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(64 - BITS)).astype(np.int32) for c in contexts]
        self.bit = buf[:, None] >> np.arange(7, -1, -1).astype(np.uint8) & 1

    def odds(self, table: np.ndarray, own: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(each predictor's log-odds toward what came, gate); own: how much of what came isn't to be counted."""
        odds, levels, shift = [], [], self.bit.astype(np.uint32) << np.uint32(4)
        for k, slot in enumerate(self.slot):
            n = table[k][slot]
            hit, miss = n >> shift & np.uint32(0xFFFF), n >> (np.uint32(16) - shift) & np.uint32(0xFFFF)
            odds.append(_LOG[own][hit] - _LOG[0][miss])
            if k in (1, 3):
                levels.append(_LEVEL[hit + miss])
        return odds, levels[0] * (_LEVELS.size + 1) + levels[1]


def _pieces(dealt: DataFrame) -> DataFrame:
    """piece, data: each part's counts of one and zero by slot, PIECE slots a row, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, t, n in _parts(batches):
            words = t.distinct[n > 0]
            for k, order in enumerate(ORDERS):  # one after another, so one table is held
                total = np.zeros(2 * SLOTS, np.uint32)
                for i in range(0, words.size, 4 * STEP):
                    c = Choices(t, words[i : i + 4 * STEP], (order,))
                    np.add.at(total, (c.slot[0] * 2 + c.bit).ravel(), np.uint32(1))
                for i in range(0, 2 * SLOTS, 2 * PIECE):
                    part = total[i : i + 2 * PIECE]
                    if part.any():
                        data = _zip(np.ascontiguousarray(part.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
                        yield _rows([(k * SLOTS // PIECE + i // (2 * PIECE), data)], ["piece", "data"], (pa.int32(), pa.binary()))

    return dealt.mapInArrow(run, "piece int, data binary")


def _summed(pieces: DataFrame) -> np.ndarray:
    """The table: of each predictor and slot the count of one (upper 16 bits) and zero; large counts keep their ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.uint64)

        def out() -> pa.RecordBatch:
            n = total.reshape(-1, 2).astype(np.float64)
            n = np.ceil(n * np.minimum(1, 65535 / np.maximum(n.max(1), 1))[:, None]).astype(np.uint32)
            return _rows([(now, _zip((n[:, 1] << np.uint32(16) | n[:, 0]).astype("<u4").tobytes()))], ["piece", "data"], (pa.int32(), pa.binary()))

        for batch in batches:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if piece != now:
                    if now is not None:
                        yield out()
                    now, total = piece, np.zeros(2 * PIECE, np.uint64)
                total += np.ascontiguousarray(np.frombuffer(_unzip(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()
        if now is not None:
            yield out()

    table = np.zeros((PREDICTORS, SLOTS), np.uint32)
    flat = table.reshape(-1, PIECE)
    summed = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "piece int, data binary")
    for r in summed.toLocalIterator():  # as large as the table at most
        flat[r["piece"]] = np.frombuffer(_unzip(bytes(r["data"])), "<u4")
    return table


def _start() -> np.ndarray:
    return np.full((GATES, PREDICTORS), 0.3, np.float32)


def fit(t: Tokens, words: np.ndarray, table: np.ndarray, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, choices by gate) by online logistic regression over words that the table holds; each step's length falls with
    the squared slopes so far."""
    weights, seen, mass = _start(), np.full((GATES, PREDICTORS), 1e-3), np.zeros(GATES)
    for i in range(0, words.size, STEP):
        odds, gate = Choices(t, words[i : i + STEP]).odds(table, 1)
        flat = gate.ravel()
        mass += np.bincount(flat, minlength=GATES)
        for _ in range(2):
            error = (1 / (1 + np.exp(np.clip(sum(o * weights[:, k][gate] for k, o in enumerate(odds)), -30, 30)))).ravel()
            for k, o in enumerate(odds):
                g = np.bincount(flat, error * o.ravel(), GATES)
                seen[:, k] += g * g
                weights[:, k] += rate * g / np.sqrt(seen[:, k])
    return weights, mass


def _averaged(fitted: DataFrame, start: np.ndarray) -> np.ndarray:
    """The mean of rows (gate, n, w: an array) by gate, weighted by n; a gate without any keeps its start.

    Sums in whole numbers don't depend on the rows' order.  One row a gate and weight reaches the driver.
    """
    out = start.astype(np.float64)
    weighted = F.round(F.col("w") * (1 << 20)).cast("decimal(20,0)") * F.col("n")
    each = fitted.where("n > 0").select("gate", "n", F.posexplode("w").alias("at", "w"))
    for r in each.groupBy("gate", "at").agg(F.sum(weighted).alias("w"), F.sum("n").alias("n")).collect():
        out[r["gate"], r["at"]] = float(r["w"]) / r["n"] / (1 << 20)
    return out


def _fitted(n: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.arange(n.size, dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(list(w.astype(np.float64)), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["gate", "n", "w"])


def learnt_weights(dealt: DataFrame, model) -> np.ndarray:
    """Weights of choices from all distinct words of training texts.  model: the broadcast table."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, t, n in _parts(batches):
            words = t.distinct[n > 0]
            weights, mass = fit(t, words[np.argsort(t.hash[words])], model.value)  # by hash, whatever blocks they came from
            yield _fitted(mass, weights)

    return _averaged(dealt.mapInArrow(learn, "gate int, n long, w array<double>"), _start()).astype(np.float32)


def _spelt(c: Choices, x: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token from its choices' log-odds."""
    return -np.bincount(c.token, np.logaddexp(np.float32(0), -x).sum(1, dtype=np.float64)) / np.log(10)


def spelling(t: Tokens, which: np.ndarray, table: np.ndarray, weights: np.ndarray, own: int) -> np.ndarray:
    """log10 of the mixed probability of each of these tokens."""
    out = [np.zeros(0)]
    for i in range(0, which.size, STEP):
        c = Choices(t, which[i : i + STEP])
        odds, gate = c.odds(table, own)
        out.append(_spelt(c, sum(o * weights[:, k][gate] for k, o in enumerate(odds))))
    return np.concatenate(out)


def earlier(t: Tokens) -> np.ndarray:
    """How often each token came before in its stream."""
    i, low = np.arange(t.code.size), t.code.size.bit_length()
    if (t.docs * max(t.distinct.size, 1)).bit_length() + low < 64:  # numbers that hold the place are sorted fastest
        key = np.sort((t.doc * t.distinct.size + t.code) << low | i)
        order, key = key & ((1 << low) - 1), key >> low
        same = key[1:] == key[:-1]
    else:
        order = np.lexsort((t.code, t.doc))
        same = (t.code[order][1:] == t.code[order][:-1]) & (t.doc[order][1:] == t.doc[order][:-1])
    before = np.empty(i.size)
    before[order] = i - np.maximum.accumulate(np.where(np.concatenate([[False], same])[: i.size], 0, i))
    return before


def predictions(t: Tokens, kind: np.ndarray, n: np.ndarray, in_class: np.ndarray, totals: np.ndarray, spelt: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PREDICTIONS probabilities of each token, gate).  n, in_class: training counts; totals: of all words, by class;
    own: one where a token's own count isn't to be counted."""
    size = np.bincount(t.doc, minlength=t.docs)
    i = np.arange(t.code.size)
    so_far = i - (np.cumsum(size) - size)[t.doc]
    before = earlier(t)
    p = np.stack([
        np.maximum(n - own, 0) / np.maximum(totals.sum() - own, 1), np.maximum(in_class - own, 0) / np.maximum(totals[kind] - own, 1),
        10.0**spelt, before / np.maximum(so_far, 1),
    ], axis=1, dtype=np.float64)
    return p, np.searchsorted(_FAR, so_far, side="right") * 2 + (kind > 0)


def _even() -> np.ndarray:
    return np.full((FAR_GATES, PREDICTIONS), 1 / PREDICTIONS)


def fit_shares(p: np.ndarray, gate: np.ndarray, rounds: int = 12, times: np.ndarray | None = None) -> np.ndarray:
    """The predictions' weights by expectation-maximisation; each gate starts with one token of each.  times: how many tokens
    each row stands for."""
    shares, times = _even(), np.ones(gate.size) if times is None else times
    for g in np.unique(gate).tolist():
        some, n, w = p[gate == g], times[gate == g], shares[g]
        for _ in range(rounds):
            w = 1 + w * (some.T @ (n / np.maximum(some @ w, 1e-300)))
            w = w / w.sum()
        shares[g] = w
    return shares


def levels(p: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """One number for the gate and the ratios of a token's predictions to the best of them, each to the nearest half power of two;
    those of less than about 2 ** -15 of it count as nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.nan_to_num(-2 * np.log2(p / p.max(1, keepdims=True)), nan=0.0, posinf=RATIOS)
    steps = np.minimum(np.rint(steps), RATIOS - 1).astype(np.int64)
    return (np.column_stack([gate, steps]) * RATIOS ** np.arange(PREDICTIONS, -1, -1)).sum(1)


def of_levels(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predictions but for a factor, gate) of such numbers."""
    digit = key[:, None] // RATIOS ** np.arange(PREDICTIONS, -1, -1)
    steps = digit[:, 1:] % RATIOS
    return np.where(steps < RATIOS - 1, 2.0 ** (-steps / 2), 0), digit[:, 0]


def refined(t: Tokens, p: np.ndarray, gate: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """log10 probability of each stream; its weights follow what each prediction did in the chunks before."""
    size = np.bincount(t.doc, minlength=t.docs)
    begin = np.cumsum(size) - size
    out, did, meant = np.zeros(t.docs), np.full((t.docs, PREDICTIONS), PATIENCE), np.full((t.docs, PREDICTIONS), PATIENCE)
    for at in range(0, int(size.max(initial=0)), CHUNK):
        d = np.flatnonzero(size > at)
        n = np.minimum(size[d] - at, CHUNK)
        first = np.cumsum(n) - n
        i = np.arange(n.sum()) + np.repeat(begin[d] + at - first, n)
        of = t.doc[i]
        w = shares[gate[i]] * (did / meant)[of]
        w /= w.sum(1, keepdims=True)
        part = w * p[i]
        one = np.maximum(part.sum(1), 1e-300)
        out[d] += np.add.reduceat(np.log10(one), first)
        did[d] += np.add.reduceat(part / one[:, None], first)
        meant[d] += np.add.reduceat(w, first)
    return out


def _known(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of a block's pairs: training counts, at all and in the class, and log10 of its spelling's probability."""
    place = np.concatenate([np.cumsum(_from_planes(k["place"]), dtype=np.uint64) for k in row["known"]]).astype(np.int64)
    n, in_class, spelt = np.zeros(place.size, np.int64), np.zeros(place.size, np.int64), np.zeros(place.size)
    n[place], in_class[place] = (np.concatenate([_from_planes(k[c]) for k in row["known"]]) for c in ("n", "in_class"))
    spelt[place] = np.concatenate([np.frombuffer(_unzip(k["spelt"]), "<f4") for k in row["known"]])
    return n, in_class, spelt


def _predicted(row: dict, classes: dict[int, int], totals: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, training count of each, whether its stream is held out, probabilities, gate) of a block."""
    t, held = Tokens(_streams(row)), np.array(row["held"], bool)
    (pair, pairs), (n, in_class, spelt) = paired(t, classes), _known(row)
    out = held[t.doc]
    p, gate = predictions(t, pairs[pair] % (CLASSES + 1), n[pair], in_class[pair], totals, spelt[pair], (~out).astype(np.int64))
    return t, n[pair], out, p, gate


def learnt_shares(asked: DataFrame, classes: dict[int, int], totals: np.ndarray) -> np.ndarray:
    """Weights of predictions from the training texts of all blocks: counts of their levels are summed over all, so blocks don't
    matter, and expectation-maximisation runs on these.  The driver gets at most 2 * FAR * 4 * RATIOS ** 3 counts, whatever the
    input's size; mostly some thousands."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, out, p, gate = _predicted(row, classes, totals)
                some = [slice(i, i + (1 << 16)) for i in range(0, gate.size, 1 << 16)]  # of tokens, so that little is held beside p
                code, key = pd.factorize(np.concatenate([np.zeros(0, np.int64), *(levels(p[i][~out[i]], gate[i][~out[i]]) for i in some)]))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.bincount(code, minlength=key.size), pa.int64())], ["key", "n"])

    counted = asked.mapInArrow(learn, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    key, n = (np.array([r[c] for r in counted], np.int64) for c in ("key", "n"))
    return fit_shares(*of_levels(key), times=n.astype(np.float64))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark, docs = df.sparkSession, two(df, id_col, text_col)
    shared = written(_shared_by_documents(docs, _frequent(docs)), "mixing-shared")
    classes = word_classes(shared)
    remove(shared)
    # As many parts as the texts' bytes ask for, so that weights learnt by parts don't depend on the session.
    parts = max(8, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART_BYTES))
    blocks = written(_blocks(docs, classes, block_bytes, parts), "mixing-blocks")
    pieces = written(_pieces(_dealt(blocks)), "mixing-pieces")
    model = spark.sparkContext.broadcast(_summed(pieces))
    remove(pieces)
    counted = written(_counted(_dealt(blocks), model, learnt_weights(_dealt(blocks), model)), "mixing-words")
    model.unpersist()
    sums = counted.where("block < 0").select("words", F.posexplode("total").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    totals, kinds = np.zeros(CLASSES + 1, np.int64), max((r["words"] for r in sums), default=0)
    for r in sums:
        totals[r["class"]] = r["n"]
    known = counted.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("place", "n", "in_class", "spelt")).alias("known"))
    asked = written(blocks.where("part < 0").select("block", "doc_id", "held", "size", "streams").join(known, "block"), "mixing-asked")
    remove(blocks)
    remove(counted)
    shares, total = learnt_shares(asked, classes, totals), int(totals.sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t, n, _, p, gate = _predicted(row, classes, totals)
                each, base = refined(t, p, gate, shares), np.bincount(t.doc, np.log10((n + 1) / (total + kinds + 1)), t.docs)
                columns = [pa.array(row["doc_id"], pa.int64()), pa.array(row["held"]), pa.array(np.bincount(t.doc, minlength=t.docs)), pa.array(np.bincount(t.doc, n > 0, t.docs).astype(np.int64)), pa.array(np.full(t.docs, total, np.int64)), pa.array(base), pa.array(each), pa.array(-each * np.log2(10) / np.array(row["size"]))]
                yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in SCORED.split(", ")])

    return asked.mapInArrow(score, SCORED)
