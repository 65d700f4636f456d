"""Near-duplicate passages by compact windows.

A text's tokens are its 5-word shingles.  For each of HASHES hash functions a Cartesian tree over the tokens' hashes (the
least is the root, then left and right of it) gives windows (left, centre, right): every subsequence within it that holds
the centre has the centre's hash as its min-hash.  Only windows of at least LEAST tokens are kept, about 2n / LEAST a hash;
a side is followed for REACH tokens, the next windows hold what lies beyond.

A window's signature is its centre with the BESIDE - 1 tokens right of it, and another one with those left of it, where the
window has them: of a repeat of LEAST tokens one side always lies within, and sixteen tokens in a row tell apart passages
whose centre is a shingle of some frequent line.  Where those are one token over and over, the run of it has two windows at most,
at its ends (_ends_of_runs()).  Windows of one signature that agree in the LEAST - 1 tokens on both sides
too, as far as they go, are copies: each is linked with the one of the least document, which stands for them.  A task does
this for its own documents first and deals only those that stand for others.  All that differ are linked with each other,
where there are up to KINDS.  Of a signature with more, a frequent line's, they are dealt again with the tokens around it and
compared there: no window is left out, each similar run keeps a partner in an earlier document, the least mostly, and similar
windows stay connected, with links in proportion to the windows instead of their pairs (related()).

The links of one pair of documents are joined along the text.  A stretch on which ENOUGH hash functions agree is a candidate
and is verified on both documents' tokens, TILE tokens a row: the longest runs of at least LEAST tokens with a Jaccard
similarity of 0.8 or more, wherever their edits are.

Null, empty and short texts have no windows.  A later document is one with a larger id; rows without an id come last and give
null ids.  Of rows with one doc_id each is compared by its own text; they don't repeat each other, nor does a text itself.
Other columns take no part, whatever their names.  An empty table gives no rows.  Texts of any length are taken whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from terrane.llm.common import _INVERSE, _ODD, Words, as_bytes, free_name, groups_of, length_updated, mix64, powers, remove, shingles_of, word_hashes, written

SHINGLE, LEAST, HASHES, ENOUGH, GAP, SIMILAR = 5, 46, 4, 1, 8, 0.8
BESIDE, REACH_BITS, TILE = 16, 11, 256
REACH = (1 << REACH_BITS) - 1
#: Tokens whose windows are found at once, and windows that a task holds before it deals them.
STRETCH, HELD = 250_000, 1_500_000
#: Different surroundings of one signature whose windows are all linked with each other; more are compared by their tokens.
KINDS = 8
SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = np.uint64((1 << 21) - 1)


def windows(x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), inclusive, of every compact window of at least `least` tokens, by centre.

    x: hashes with their places in the low 21 bits, so of equal ones the first is the least; zero at both ends and between
    texts.  Those are the nodes of the Cartesian trees that are the least of some `least` tokens in a row; their sides are
    found by halving steps over the minima of 1, 2, 4, ... tokens.
    """
    levels = [x]
    while len(levels) < REACH_BITS and levels[-1].size > 1 << len(levels) - 1:
        w = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
    j, n = least.bit_length() - 1, x.size - least + 1
    if j >= len(levels) or n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    lowest = np.minimum(levels[j][:n], levels[j][least - (1 << j) :][:n])
    at = (lowest[lowest > 0] & _PLACE).astype(np.int64)
    c = at[np.flatnonzero(np.diff(at, prepend=-1))]
    own, left, right = x[c], c.copy(), c + 1
    for j in range(len(levels) - 1, -1, -1):
        w, low = 1 << j, levels[j]
        go = (left >= w) & (low[np.maximum(left - w, 0)] > own)
        left[go] -= w
        go = (right < low.size) & (low[np.minimum(right, low.size - 1)] > own)
        right[go] += w
    return left, c, right - 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = STRETCH + 2 * (REACH + LEAST) + 4
    return powers(_ODD, n), powers(_INVERSE, n)


def _equal_runs(t: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) place of the run of equal tokens that holds each place; a wall is a run by itself."""
    edge = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | wall[1:] | wall[:-1]]))
    size = np.diff(edge, append=t.size)
    return np.repeat(edge, size), np.repeat(edge + size - 1, size)


def _ends_of_runs(left: np.ndarray, c: np.ndarray, right: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows without those whose BESIDE tokens from the centre on are one token over and over, but for two of each such run:
    the run's first, and the one of its last BESIDE tokens with what all of them hold.

    The others would have the same signature.  What two such runs share holds the beginning of both, or the end of both, or
    nothing but this token; so it lies around the same place of two windows that stay.
    """
    many = c + BESIDE - 1 <= end[c]
    if not many.any():
        return left, c, right
    stay = ~many | (c == begin[c])
    at = end[c[many]]
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    low, high, at = np.minimum.reduceat(left[many], edge), np.maximum.reduceat(right[many], edge), at[edge] - BESIDE + 1
    low, some = np.maximum(low, at - REACH), high >= at + BESIDE - 1
    return np.append(left[stay], low[some]), np.append(c[stay], at[some]), np.append(right[stay], high[some])


def signatures(t: np.ndarray, wall: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, near, centre, tokens before it, after it, hash functions as bits) for laid-out tokens; wall: where no token is."""
    beyond, (up, down) = REACH + LEAST, _powers()
    for first in range(0, t.size, STRETCH):
        low, high = max(first - beyond, 0), min(first + STRETCH + beyond, t.size)
        part, shut = np.concatenate([t[:1], t[low:high], t[:1]]), np.concatenate([[True], wall[low:high], [True]])
        codes, befores, afters, bits = [], [], [], []
        begin, end = _equal_runs(part, shut)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: part.size], dtype=np.uint64)])
            for k, seed in enumerate(SEEDS):
                x = (part * seed) & ~_PLACE | np.arange(part.size, dtype=np.uint64)
                x[shut] = 0
                left, c, right = windows(x)
                left, c, right = _ends_of_runs(left, c, right, begin, end)
                own = (c > first - low) & (c <= first - low + STRETCH)
                left, c, right = left[own], c[own], right[own]
                for side, there in enumerate((right - c >= BESIDE - 1, c - left >= BESIDE - 1)):
                    codes.append(c[there] * 2 + side)
                    befores.append((c - left)[there])
                    afters.append((right - c)[there])
                    bits.append(np.full(int(there.sum()), 1 << k))
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            code = code[order]
            edge = np.flatnonzero(np.diff(code, prepend=-1))
            if not edge.size:
                continue
            before, after, bit = (f.reduceat(np.concatenate(x)[order], edge) for f, x in ((np.maximum, befores), (np.maximum, afters), (np.bitwise_or, bits)))
            c, side = code[edge] >> 1, code[edge] & 1
            run = c - side * (BESIDE - 1)
            key = mix64(((total[run + BESIDE] - total[run]) * down[run]) ^ side.astype(np.uint64))
            near = _near(total, down, c, before, after)
        yield key, near, c - 1 + low, before, after, bit


def _near(total: np.ndarray, down: np.ndarray, c: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """32-bit hashes of up to LEAST - 1 tokens on both sides of windows' centres; total: sums of the tokens before each."""
    before, after = np.minimum(before, LEAST - 1), np.minimum(after, LEAST - 1)
    with np.errstate(over="ignore"):
        h = (total[c + after + 1] - total[c - before]) * down[c - before]
        return (mix64(h ^ (before << 8 | after).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _laid(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(tokens, walls, where each text's tokens begin, first text, end) of groups of texts, a wall before and after each text."""
    for a, b in groups_of(texts):
        if b - a == 1:
            tokens = shingles_of(word_hashes(texts[a]), SHINGLE)
            of = np.array([0, tokens.size])
        else:
            tokens, of = Words(texts[a:b]).shingles(SHINGLE)
        size = np.diff(of)
        begin = of[:-1] + np.arange(1, b - a + 1)
        t, wall = np.zeros(tokens.size + b - a + 1, np.uint64), np.ones(tokens.size + b - a + 1, bool)
        at = np.arange(tokens.size) + np.repeat(begin - of[:-1], size)
        t[at], wall[at] = tokens, False
        yield t, wall, begin, a, b


def _pair_key(doc: np.ndarray, source: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(doc.view(np.uint64)) + source.view(np.uint64) * _ODD)


DEALT = "key long, near int, doc long, at long, source long, sat long"
LINK = "doc long, source long, at long, sat long"
_DEALT, _LINK = (["key", "near", "doc", "at", "source", "sat"], ["doc", "source", "at", "sat"])


def _rows(*columns: np.ndarray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for k in range(0, columns[0].size, most):
        cut = [c[k : k + most] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cut], _DEALT if len(columns) == 6 else _LINK)


def _linked(doc: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, source, at, sat for pairs i, j of rows; those of one document aren't linked."""
    later = doc[i] > doc[j]
    of, to = np.where(later, i, j), np.where(later, j, i)
    some = doc[of] != doc[to]
    of, to = of[some], to[some]
    return doc[of], doc[to], at[of], at[to]


class _Deal:
    """Windows that a task holds before it deals them: rows of DEALT, a window (source is its own document) or a link."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, key: np.ndarray, near: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        self.held.append((key, near, doc, at))
        self.size += key.size

    def out(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        if self.size <= most:
            return
        key, near, doc, at = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.lexsort((at, doc, near, key))
        key, near, doc, at = key[order], near[order], doc[order], at[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (near[1:] != near[:-1])])
        first = np.maximum.accumulate(np.where(fresh, np.arange(key.size), 0))
        copies = np.flatnonzero(~fresh)
        links = _linked(doc, at, copies, first[copies])
        yield from _rows(key[fresh], near[fresh], doc[fresh], at[fresh], doc[fresh], at[fresh])
        yield from _rows(_pair_key(links[0], links[1]), np.zeros(links[0].size, np.int32), links[0], links[2], links[1], links[3])


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT for all windows of texts."""
    deal = _Deal()
    for batch in batches:
        ids = batch.column("doc").to_numpy()
        for t, wall, begin, a, b in _laid(as_bytes(batch.column("text"))):
            for key, near, c, before, after, bits in signatures(t, wall):
                of = np.searchsorted(begin, c, side="right") - 1
                deal.add(key, near, ids[a:b][of], (c - begin[of]) << 32 | before << 20 | after << 8 | bits)
            yield from deal.out(HELD)
    yield from deal.out()


#: Tokens of a frequent signature's window: the signature's own and LEAST - 1 on both sides.
_AROUND = BESIDE + 2 * (LEAST - 1)
#: Windows of whole signatures that are compared at once.
_WINDOWS = 4096
AGAIN = "key long, doc long, at long, tokens binary"


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of AGAIN for windows of signatures with more than KINDS surroundings: doc, text, windows (at, key).

    tokens: a mark for each of _AROUND places, whether the text has it, and 32 bits of its token there.  at: the place, as far
    as these tokens go, by all hash functions.
    """
    for batch in batches:
        ids, given = batch.column("doc").to_numpy(), batch.column("windows")
        for t, wall, begin, a, b in _laid(as_bytes(batch.column("text"))):
            part = given.slice(a, b - a)
            of = np.repeat(np.arange(b - a), pc.list_value_length(part).to_numpy())
            at, key = (part.flatten().field(n).to_numpy() for n in ("at", "key"))
            key, c = key.view(np.uint64), begin[of] + (at >> 32)
            before, after, end = at >> 20 & 0xFFF, at >> 8 & 0xFFF, np.append(begin[1:], t.size)[of] - 1
            up, down = powers(_ODD, t.size + 1), powers(_INVERSE, t.size + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * up[: t.size], dtype=np.uint64)])

                # Another row of the id may have another text, without the window.
                fits = (c - before >= begin[of]) & (c + after < end)
                of, key, c, end = (x[fits] for x in (of, key, c, end))
                side = np.full(c.size, -1)
                for k, there in enumerate((c + BESIDE <= end, c - BESIDE + 1 >= begin[of])):
                    s = c[there] - k * (BESIDE - 1)
                    run = (total[s + BESIDE] - total[s]) * down[s]
                    side[np.flatnonzero(there)[mix64(run ^ np.uint64(k)) == key[there]]] = k
            fits = side >= 0
            of, key, c, end, side = (x[fits] for x in (of, key, c, end, side))
            low = c - side * (BESIDE - 1) - (LEAST - 1)
            for i in range(0, c.size, 1 << 14):
                k = slice(i, i + (1 << 14))
                place = low[k, None] + np.arange(_AROUND)
                has = (place >= begin[of[k], None]) & (place < end[k, None])
                tokens = np.where(has, t[np.clip(place, 0, t.size - 1)], 0).astype("<u4")
                rows = np.concatenate([has.view(np.uint8), tokens.view(np.uint8)], axis=1)
                left, right = c[k] - np.maximum(low[k], begin[of[k]]), np.minimum(low[k] + _AROUND, end[k]) - 1 - c[k]
                there = (c[k] - begin[of[k]]) << 32 | left << 20 | right << 8 | (1 << HASHES) - 1
                columns = key[k].view(np.int64), ids[a:b][of[k]], there, pa.FixedSizeBinaryArray.from_buffers(pa.binary(5 * _AROUND), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc", "at", "tokens"])


def _reach(hit: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) place of the runs of at least LEAST that begin and end at a mark, hold the signature's places and whose
    scores sum to zero at least, for rows of _AROUND; (_AROUND, -1) without any.  Together the runs are what lies between."""
    q = np.concatenate([np.zeros((len(hit), 1), np.int64), np.cumsum(score, axis=1)], axis=1)
    return _ends(hit, q[:, :LEAST], q[:, -LEAST:])


def _ends(hit: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _reach(), for runs whose end has at least the score that their begin has: those of the first and last LEAST places."""
    side, far = np.arange(LEAST), np.asarray(begin).dtype.type(np.iinfo(begin.dtype).max // 2)
    begin = np.where(hit[:, :LEAST], begin, far)
    end = np.where(hit[:, -LEAST:], end, -far)
    most = np.maximum.accumulate(end[:, ::-1], axis=1)[:, ::-1][:, np.maximum(side - BESIDE + 1, 0)]
    least = np.minimum.accumulate(begin, axis=1)[:, np.minimum(side + BESIDE - 1, LEAST - 1)]
    first, last = most >= begin, least <= end
    return np.where(first.any(1), first.argmax(1), _AROUND), np.where(last.any(1), _AROUND - 1 - last[:, ::-1].argmax(1), -1)


def _in_order(there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last) as _reach() has them, exactly, where the third holds; there: place in the partner of each of _AROUND tokens
    that occur once in both, -1 for those that it lacks.

    Where equal tokens come in the same order, a run and its partner have as many in common as there are marks.
    """
    hit, places, half = there >= 0, np.arange(_AROUND, dtype=np.int16), round(10 * SIMILAR)
    worth = (10 + half) * np.cumsum(hit, axis=1, dtype=np.int16) - half * (places + there)
    first, last = _ends(hit, worth[:, :LEAST] - (10 + half) * hit[:, :LEAST], worth[:, -LEAST:] - 2 * half)
    turn = hit[:, 1:] & (there[:, 1:] < np.maximum.accumulate(there, axis=1)[:, :-1])
    return first, last, ~(turn & (places[1:] > first[:, None]) & (places[1:] <= last[:, None])).any(1)


def _unbroken(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) place of the marks around the signature's without a break, for rows of _AROUND."""
    before, after = same[:, : LEAST - 1][:, ::-1], same[:, LEAST + BESIDE - 1 :]
    return LEAST - 1 - before.cumprod(1).sum(1), LEAST + BESIDE - 2 + after.cumprod(1).sum(1)


def _news(code: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of _AROUND tokens: whether one is new, going outward from the signature (within it, its first), and whether it
    is new on the other side too."""
    rows, size = code.shape
    place = np.arange(size)
    far = np.where(place < LEAST - 1, LEAST - 1 - place, np.maximum(place - (LEAST + BESIDE - 2), 0)) * size + place  # the order of going
    by = np.lexsort((np.broadcast_to(far, code.shape), np.broadcast_to(np.where(place < LEAST - 1, 1, np.where(place > LEAST + BESIDE - 2, 2, 0)), code.shape), code), axis=1)
    ordered, side = np.take_along_axis(code, by, 1), np.searchsorted([LEAST - 1, LEAST + BESIDE - 1], by, side="right")
    side = np.array([1, 0, 2])[side]
    fresh = np.concatenate([np.ones((rows, 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
    start = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    inner = np.take_along_axis(side, start, 1) == 0
    turn = np.concatenate([np.zeros((rows, 1), bool), side[:, 1:] != side[:, :-1]], axis=1) & ~fresh
    new_, both_ = fresh | (turn & ~inner), turn & ~inner & (np.take_along_axis(side, start, 1) == 1)
    back = np.flatnonzero(both_.ravel())
    both_.ravel()[(back // size) * size + start.ravel()[back]] = True
    new, both = np.zeros_like(new_), np.zeros_like(both_)
    np.put_along_axis(new, by, new_, 1)
    np.put_along_axis(both, by, both_, 1)
    return new & (code < none), both


def _mode(x: np.ndarray, none: int) -> np.ndarray:
    """The most frequent number of each row, the least of several; -1 for rows of `none` alone."""
    x = np.sort(x, axis=1)
    place = np.arange(x.shape[1])
    fresh = np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], axis=1)
    times = np.where(x < none, place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1), -1)
    best = times.argmax(1)
    at = np.arange(len(x))
    return np.where(times[at, best] >= 0, x[at, best], -1)


def related(doc: np.ndarray, tokens: np.ndarray, sign: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(later row, earlier row) for windows in order of signature (sign; without it they have one) and doc; tokens: rows of
    _AROUND, below zero where none is.

    What lies around the signature in a window and is similar enough to a run of an earlier document, as verify() has it, is so
    to partners given here; and windows that are similar are connected, if not always by a link of their own.  So there are
    links in proportion to the windows, whatever they share.  All windows are compared at once with the earlier ones that hold
    most of their tokens.  Where that leaves a run that could be longer, or groups that could be connected, by the tokens that
    they have, the window is compared with all others that could do so (_compared()).
    """
    sign = np.zeros(doc.size, np.int64) if sign is None else sign
    kinds, code = np.unique(np.where(tokens < 0, -1, sign[:, None] << 32 | tokens), return_inverse=True)
    code = code.reshape(tokens.shape) - int(kinds.size > 0 and kinds[0] < 0)
    none = kinds.size - int(kinds.size > 0 and kinds[0] < 0)
    code[code < 0] = none
    ordered = np.sort(code, axis=1)
    once = ~((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] < none)).any(1)
    shared = np.append(np.bincount(code.ravel(), minlength=none + 1)[:none] > 1, False)[code]
    some = np.flatnonzero(~once | (shared.sum(1) >= SIMILAR * LEAST))
    if not some.size:
        return []
    code, doc, sign, shared, once = code[some], doc[some], sign[some], shared[some], once[some]
    # Of a similar run's tokens, each counted once, no more are strange than a quarter of the equal ones; halves are counted twice.
    new, both = code < none, np.zeros(code.shape, bool)
    if not once.all():
        new[~once], both[~once] = _news(code[~once], none)
    equal, strange = 2 * new, np.where(code < none, -4 * (2 * new - both), -(1 << 20))
    could_low, could_high = _reach(shared, np.where(shared, equal, strange))
    # Windows that are equal but for tokens that no other one has: the first of them stands for all that it covers whole.
    with np.errstate(over="ignore"):
        alike = mix64(np.where(shared | (code == none), code, none + 1).astype(np.uint64) + np.uint64(1)) * powers(_ODD, _AROUND)
        _, first, of = np.unique(mix64(alike.sum(1, dtype=np.uint64) ^ mix64(sign.astype(np.uint64))), return_index=True, return_inverse=True)
    first = first[of.ravel()]
    strict_low, strict_high = _reach(shared, np.where(shared, equal, 2 * strange))
    low_, high_ = _unbroken(shared)
    whole = once & (strict_low == could_low) & (strict_high == could_high) | (low_ == could_low) & (high_ == could_high) | (could_high < 0)
    gone = (doc[first] < doc) & whole
    out = [(int(some[i]), int(some[first[i]])) for i in np.flatnonzero(gone & (could_high >= 0))]
    some, code, doc, sign, once, equal, strange = (x[~gone] for x in (some, code, doc, sign, once, equal, strange))
    n = some.size
    if not n:
        return out

    # Only tokens that an earlier document has, too, can belong to a run.
    window = np.broadcast_to(np.arange(n)[:, None], code.shape)
    holder, before = np.full(none + 1, n), np.full(code.size, n)
    holder[code.ravel()[::-1]] = window.ravel()[::-1]
    order = np.argsort(code, axis=None, kind="stable")
    again = np.flatnonzero(code.ravel()[order][1:] == code.ravel()[order][:-1])
    before[order[again + 1]] = order[again] // _AROUND
    before = before.reshape(code.shape)
    docs = np.append(doc, np.iinfo(np.int64).max)
    holder = holder[code]
    old = (code < none) & (docs[holder] < doc[:, None])
    could_low, could_high = _reach(old, np.where(old, equal, strange))
    holder, before = np.where(old, holder, n), np.where(old & (docs[before] < doc[:, None]), before, n)
    by = np.argsort(code, axis=1)
    lines = (np.arange(n)[:, None] * (none + 1) + np.take_along_axis(code, by, 1)).ravel()
    low, high, group, linked, places = np.full(n, _AROUND), np.full(n, -1), list(range(n)), [set() for _ in range(n)], np.arange(_AROUND)

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def open_() -> np.ndarray:
        return np.flatnonzero((could_high >= 0) & ((could_low < low) | (could_high > high)))

    for holders, beyond in ((holder, False), (before, False), (holder, True)):
        i = open_()
        at = holders[i]
        if beyond:
            at = np.where(((places < low[i, None]) & (places >= could_low[i, None])) | ((places > high[i, None]) & (places <= could_high[i, None])), at, n)
        j = _mode(at, n)
        fits = (j >= 0) & once[i] & once[j]
        i, j = i[fits], j[fits]
        if not i.size:
            continue
        wanted = (j[:, None] * (none + 1) + code[i]).ravel()
        found = np.minimum(np.searchsorted(lines, wanted), lines.size - 1)
        hit = (lines[found] == wanted).reshape(-1, _AROUND) & (code[i] < none)
        there = np.where(hit, by.ravel()[found].reshape(-1, _AROUND), -1)
        a, b, sure = _in_order(there.astype(np.int16))
        sure &= b >= 0
        for i, j, a, b in zip(*(x[sure].tolist() for x in (i, j, a, b)), strict=True):
            if a < low[i] or b > high[i] or top(i) != top(j):
                linked[i].add(j)
                group[top(i)] = top(j)
                low[i], high[i] = min(a, low[i]), max(b, high[i])

    first = _holders(code, none)
    early = docs[first] < doc
    lowest, highest = early[:LEAST], early[BESIDE - 1 :][::-1]
    for j in (np.where(lowest.any(0), first[lowest.argmax(0), range(n)], n), np.where(highest.any(0), first[len(first) - 1 - highest.argmax(0), range(n)], n)):
        i = open_()
        i = i[j[i] < n]
        a, b = _unbroken((code[i] == code[j[i]]) & (code[i] < none))
        some_ = (a < low[i]) | (b > high[i])
        for i, j, a, b in zip(*(x[some_].tolist() for x in (i, j[i], a, b)), strict=True):
            linked[i].add(j)
            group[top(i)] = top(j)
            low[i], high[i] = min(a, low[i]), max(b, high[i])
    for k in range(BESIDE - 1, LEAST):
        # Others of the first document are linked from the first later one.
        i = np.flatnonzero(early[k])
        later = np.full(n, n)
        later[first[k, i[::-1]]] = i[::-1]
        own = np.flatnonzero(~early[k] & (first[k] < np.arange(n)))
        i, j = np.concatenate([i, later[first[k, own]]]), np.concatenate([first[k, i], own])
        i, j = i[i < n], j[i < n]
        apart = np.array(group)
        while (apart[apart] != apart).any():
            apart = apart[apart]
        apart = apart[i] != apart[j]
        for i, j in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            if top(i) != top(j):
                linked[i].add(j)
                group[top(i)] = top(j)

    group = np.array([top(i) for i in range(n)])
    wanting = _wanting(code, none, old, equal, strange, could_low, could_high, group, low, high)
    edge = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1], [True]]))
    taken, size = [], 0
    for x, y in [*zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True), (n, n)]:
        if taken and (size + y - x > _ALONE or x == n):
            k = np.concatenate(taken)
            _compared(*(v[k] for v in (code, sign, doc, once, old, equal, strange, could_low, could_high, group, low, high, wanting)), none, linked, k)
            taken, size = [], 0
        if wanting[x:y].any():
            taken.append(np.arange(x, y))
            size += y - x
    return out + [(int(some[i]), int(some[j])) for i in range(n) for j in sorted(linked[i])]


#: (first, end) of stretches around a signature: by their beginning, the shortest one of LEAST tokens at least, then longer ones that
#: begin with it, by their end.
_STRETCHES = [(a, max(a + LEAST, LEAST - 1 + BESIDE)) for a in range(LEAST)] + [(LEAST - 1, b) for b in range(2 * LEAST, _AROUND + 1)]


def _holders(code: np.ndarray, none: int) -> np.ndarray:
    """By stretch, for rows of _AROUND tokens, the first row that has the same tokens there; a row itself where it lacks some."""
    with np.errstate(over="ignore"):
        total = np.cumsum(mix64(code.astype(np.uint64) + np.uint64(1)) * powers(_ODD, _AROUND), axis=1, dtype=np.uint64)
        total, lacks = (np.pad(x, ((0, 0), (1, 0))) for x in (total, np.cumsum(code == none, axis=1)))
        first = np.repeat(np.arange(len(code))[None], len(_STRETCHES), 0)
        for k, (a, b) in enumerate(_STRETCHES):
            some = np.flatnonzero(lacks[:, a] == lacks[:, b])
            _, at, of = np.unique(total[some, b] - total[some, a], return_index=True, return_inverse=True)
            first[k, some] = some[at[of]]
    return first


#: Pairs of windows that are compared at once.
_PAIRS = 4096
#: Places of tokens by partner that are held for that.
_PLACES = 1 << 25


#: Partners of a larger signature's windows that are tried before what is left wanting is looked up again.
_FEW = 64
#: Windows up to which those of several signatures are compared together, which doesn't change what they get.
_ALONE = _PAIRS // 16


def _wanting(code, none, old, equal, strange, could_low, could_high, group, low, high) -> np.ndarray:
    """Windows that could have a longer run, or be similar to one of another group, by the tokens that earlier documents have."""
    ends = np.full((2, none + 1), -1)
    by_group = np.argsort(group, kind="stable")
    ends[0][code[by_group[::-1]].ravel()] = np.repeat(group[by_group[::-1]], _AROUND)
    ends[1][code[by_group].ravel()] = np.repeat(group[by_group], _AROUND)
    others = old & ((ends[0][code] != group[:, None]) | (ends[1][code] != group[:, None]))
    longer = (could_high >= 0) & ((could_low < low) | (could_high > high))
    return longer | (_reach(others, np.where(others, equal, strange))[1] >= 0)


def _compared(code, sign, doc, once, old, equal, strange, could_low, could_high, group, low, high, wanting, none, linked, rows) -> None:
    """Adds to linked (sets of rows) what the wanting windows of some whole signatures lack: each is compared with all earlier ones
    of its own but those that can neither make a run longer nor connect two groups, by the tokens that they have.  What is left
    wanting after the first few partners is looked up again, since most of it lacks nothing then."""
    size, places = doc.size, np.arange(_AROUND, dtype=np.int16)
    kinds, inner = np.unique(code, return_inverse=True)
    code, none = inner.reshape(code.shape), int(np.searchsorted(kinds, none))
    earlier = np.maximum.accumulate(np.where(np.concatenate([[True], (sign[1:] != sign[:-1]) | (doc[1:] != doc[:-1])]), np.arange(size), 0))

    def found(i: int, j: int, a: int, b: int) -> tuple[int, int]:
        """The runs of a pair, which lie between a and b."""
        here, other = set(code[i, a : b + 1].tolist()), code[j].tolist()
        p, q = LEAST - 1, LEAST + BESIDE - 2
        while p and other[p - 1] in here:
            p -= 1
        while q + 1 < _AROUND and other[q + 1] in here:
            q += 1
        there = set(other[p : q + 1])
        if b - a >= LEAST - 1 and none not in here and len(here & there) >= SIMILAR * len(here | there):
            return a, b
        here, there = (x[x < none] for x in (code[i], code[j]))
        skipped = int((code[i] < none).argmax())
        runs = [(a + skipped, b + skipped) for a, b in verify(here, there) if a + skipped < LEAST and b + skipped >= LEAST + BESIDE - 2]
        return min((a for a, _ in runs), default=_AROUND), max((b for _, b in runs), default=-1)

    held = np.unique(code * size + np.arange(size)[:, None])  # a token of a window once
    order, edge = held % size, np.searchsorted(held, np.arange(none + 2) * size)
    often = np.append(np.diff(edge)[:none], 0)
    wide, step = max(_PLACES // (none + 1), 1), max(_PLACES // (8 * size), 1)
    few = min(wide, _FEW if size > _ALONE else size)
    for begin in (0, *range(few, size, wide)):  # some partners after others, so that a bounded table says where they have which token
        if begin:
            wanting = _wanting(code, none, old, equal, strange, could_low, could_high, group, low, high)
        asking = np.flatnonzero(wanting & (could_high >= 0))
        there = code[begin : begin + wide if begin else few]
        where = np.full((len(there), none + 1), -1, np.int16)
        where[np.arange(len(there))[:, None], there] = places
        where[:, none] = -1
        for at in range(0, asking.size, step):
            some = asking[at : at + step]
            some = some[earlier[some] > begin]
            beyond = _beyond(places, some, low, high, could_low, could_high)
            # Others have a token there, or, of another group, one that isn't among the most frequent beside the signature.
            rare = np.where((places >= LEAST - 1) & (places < LEAST + BESIDE - 1) | (code[some] == none), 1 << 30, often[code[some]])
            rare = np.argsort(np.argsort(rare, axis=1, kind="stable"), axis=1) < ((rare < 1 << 30).sum(1) - np.where(once[some], math.ceil(SIMILAR * LEAST) - BESIDE - 1, 0))[:, None]
            use = np.zeros((some.size, size), bool)
            for tokens, other in ((rare, True), (beyond, False)):
                of, which = np.nonzero(tokens & (code[some] < none))
                of, c = np.divmod(np.unique(of * (none + 1) + code[some][of, which]), none + 1)
                for cut in _cuts(often[c]):
                    n = often[c[cut]]
                    use[np.repeat(of[cut], n), order[np.arange(n.sum()) + np.repeat(edge[c[cut]] - (np.cumsum(n) - n), n)]] = True
                if other:
                    use &= group[some][:, None] != group
            use[:, : begin] = False
            use[:, begin + len(there) :] = False
            use &= np.arange(size) < earlier[some][:, None]
            i, j = np.nonzero(use)
            # Some partners of each window after others, as it may lack none any more.
            turn = (np.arange(i.size) - np.searchsorted(i, i)) // 16
            by = np.argsort(turn, kind="stable")
            i, j, turn = some[i[by]], j[by], np.flatnonzero(np.diff(turn[by], prepend=-1))
            for a, b in zip(turn.tolist(), np.append(turn, i.size)[1:].tolist(), strict=True):
                for cut in range(a, b, _PAIRS):
                    k = slice(cut, min(cut + _PAIRS, b))
                    _pairwise(i[k], j[k], begin, code, where, once, equal, strange, could_low, could_high, group, low, high, linked, rows, found)


def _cuts(n: np.ndarray, most: int = 1 << 22) -> Iterator[slice]:
    """Runs whose numbers sum to about most."""
    total, a = np.cumsum(n), 0
    while a < n.size:
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + most)), a + 1)
        yield slice(a, b)
        a = b


def _beyond(places, i, low, high, could_low, could_high) -> np.ndarray:
    """Of windows the places where a run could be longer."""
    low, high, could_low, could_high = (x[i, None].astype(np.int16) for x in (low, high, could_low, could_high))
    return (places < low) & (places >= could_low) | (places > high) & (places <= could_high)


def _pairwise(i, j, begin, code, where, once, equal, strange, could_low, could_high, group, low, high, linked, rows, found) -> None:
    places = np.arange(_AROUND, dtype=np.int16)
    open_ = (low[i] > could_low[i]) | (high[i] < could_high[i]) | (group[i] != group[j])
    i, j = i[open_], j[open_]
    there = where[j[:, None] - begin, code[i]]
    hit = there >= 0
    use = (hit & _beyond(places, i, low, high, could_low, could_high)).any(1) | (group[i] != group[j])
    use &= ~(once[i] & (hit.sum(1) < SIMILAR * LEAST))
    i, j, there, hit = (x[use] for x in (i, j, there, hit))
    if not i.size:
        return
    a, b, sure = _in_order(there)
    sure &= once[i] & once[j]
    unsure = np.flatnonzero(~sure)
    if unsure.size:
        a[unsure], b[unsure] = _reach(hit[unsure], np.where(hit[unsure], equal[i[unsure]], strange[i[unsure]]))
        # So it is where nothing but one unbroken stretch could do.
        first, last = _unbroken((code[i[unsure]] == code[j[unsure]]) & hit[unsure])
        sure[unsure] = (first == a[unsure]) & (last == b[unsure]) & (last - first >= LEAST - 1)
    more = np.flatnonzero((b >= 0) & ((a < low[i]) | (b > high[i]) | (group[i] != group[j])))
    more = more[np.lexsort((a[more] - b[more], ~sure[more], i[more]))]
    for i, j, a, b, known in zip(*(x[more].tolist() for x in (i, j, a, b, sure)), strict=True):
        if a < low[i] or b > high[i] or group[i] != group[j]:
            if not known:
                a, b = found(i, j, a, b)
            if b >= 0 and (a < low[i] or b > high[i] or group[i] != group[j]):
                linked[rows[i]].add(int(rows[j]))
                group[group == group[i]] = group[j]
                low[i], high[i] = min(a, low[i]), max(b, high[i])


def _related(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LINK from those of AGAIN in order of key and doc; the windows of several signatures are compared at once."""
    held: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        key, doc, at, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        links = np.array(related(doc, tokens, np.cumsum(np.diff(key, prepend=key[:1]) != 0)), np.int64).reshape(-1, 2)
        yield from _rows(*_linked(doc, at, links[:, 0], links[:, 1]))

    size = 0
    for batch in batches:
        key, doc, at = (batch.column(n).to_numpy() for n in ("key", "doc", "at"))
        flat = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint8).reshape(-1, 5 * _AROUND)
        tokens = np.where(flat[:, :_AROUND] > 0, np.ascontiguousarray(flat[:, _AROUND:]).view("<u4").astype(np.int64), -1)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else []
        for a, b in zip(edge, [*edge[1:], key.size], strict=True) if key.size else ():
            if size >= _WINDOWS and key[a] != held[-1][0][-1]:
                yield from out()
                held, size = [], 0
            held.append((key[a:b], doc[a:b], at[a:b], tokens[a:b]))
            size += b - a
    if held:
        yield from out()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LINK from those of DEALT in order of key, near and doc.

    The windows of a key that stand for others are held until it ends or there are more than KINDS; those of such a key are
    given as rows with themselves as source and the key in sat, to be dealt again.
    """
    held, large = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)], False
    for batch in chain(batches, [None]):
        rows, old = held, held[0].size
        if batch is not None:
            key, near, doc, at, source, sat = (batch.column(n).to_numpy() for n in _DEALT)
            done = source != doc
            yield from _rows(doc[done], source[done], at[done], sat[done])
            rows = [np.concatenate([h, x[~done]]) for h, x in zip(held, (key, near, doc, at), strict=True)]
        key, near, doc, at = rows
        if not key.size:
            continue
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = starts | np.concatenate([[True], near[1:] != near[:-1]])
        stands = np.maximum.accumulate(np.where(fresh, np.arange(key.size), 0))
        copies = np.flatnonzero(~fresh)
        yield from _rows(*_linked(doc, at, copies, stands[copies]))
        r = np.flatnonzero(fresh)
        group = np.cumsum(starts[r]) - 1
        size = np.bincount(group)
        begin, i = (np.cumsum(size) - size)[group], np.arange(r.size)
        many = size > KINDS
        many[0] |= large
        open_ = group == size.size - 1 if batch is not None else np.zeros(r.size, bool)
        few, back = i[~many[group] & ~open_], 1
        pairs = []
        while (few := few[few - begin[few] >= back]).size:
            pairs.append((r[few], r[few - back]))
            back += 1
        new = i[many[group] & (i >= (old if large else 0))]
        yield from _rows(doc[r[new]], doc[r[new]], at[r[new]], key[r[new]])
        if pairs:
            yield from _rows(*_linked(doc, at, *(np.concatenate(x) for x in zip(*pairs, strict=True))))
        mine, large = r[group == size.size - 1], bool(many[-1])
        held = [x[mine[[0, -1]] if large else mine] for x in rows]


PAIR = "doc long, source long, spans array<struct<a:int,b:int,x:int,y:int>>"
_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in "abxy"]))


def spans_of(links: list[tuple[int, int]]) -> list[dict]:
    """Candidate stretches a..b of a document and x..y of its source from their links (at, sat) in order of at."""
    found = []
    for at, sat in links:
        c, fc = at >> 32, sat >> 32
        before, after = min(at >> 20 & 0xFFF, sat >> 20 & 0xFFF), min(at >> 8 & 0xFFF, sat >> 8 & 0xFFF)
        found.append((c - before, c, fc, after, before, at & sat & 0xFF))
    groups: list[list] = []  # [first, last, source's first, source's last, hash functions, last difference]
    near: dict[int, list] = {}  # by last difference: the groups that a link may join; starts only grow, so others are let go
    for start, c, fc, after, before, bits in sorted(found):
        span, at = (start, c + after, fc - before, fc + after), (c - fc) // (LEAST + 1)
        for n in (at - 1, at, at + 1):
            near[n] = [g for g in near.get(n, ()) if start <= g[1] + GAP]
        fits = [g for n in (at - 1, at, at + 1) for g in near[n] if abs(c - fc - g[5]) <= LEAST]
        if fits:
            g = min(fits, key=lambda g: abs(c - fc - g[5]))
            near[g[5] // (LEAST + 1)] = [x for x in near[g[5] // (LEAST + 1)] if x is not g]
            g[0], g[1], g[2], g[3] = min(g[0], span[0]), max(g[1], span[1]), min(g[2], span[2]), max(g[3], span[3])
            g[4] |= bits
            g[5] = c - fc
        else:
            g = [*span, bits, c - fc]
            groups.append(g)
        near[at].append(g)
    # What lies next to the outermost windows may belong to the passage too.
    return [{"a": max(a - BESIDE, 0), "b": b + BESIDE, "x": max(x - BESIDE, 0), "y": y + BESIDE} for a, b, x, y, bits, _ in groups if bits.bit_count() >= ENOUGH]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAIR from links in order of doc, source and at."""

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), _SPANS), strict=True)], ["doc", "source", "spans"])

    now, links, found = None, [], []
    for batch in batches:
        doc, source, at, sat = (batch.column(n).to_numpy() for n in _LINK)
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])])) if doc.size else []
        for a, b in zip(edge, [*edge[1:], doc.size], strict=True):
            pair = int(doc[a]), int(source[a])
            if pair != now:
                if links:
                    found.append((*now, spans_of(links)))
                now, links = pair, []
            links += zip(at[a:b].tolist(), sat[a:b].tolist(), strict=True)
        if len(found) > 5000:
            yield out(found)
            found = []
    if links:
        found.append((*now, spans_of(links)))
    yield out(found)


TILES = "id long, tile int, hash long, none boolean, tokens array<int>"


def _tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "tile", "hash", "none", "tokens"]
    kinds = pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int32())
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        doc, hashes, none, wanted = (batch.column(n).to_pylist() for n in ("doc", "hash", "none", "tiles"))
        for t, _, begin, a, b in _laid(texts):
            rows, ends = [], [*(begin[1:] - 1), t.size - 1]
            for i in range(a, b):
                tokens = t[begin[i - a] : ends[i - a]].astype(np.uint32).view(np.int32)
                rows += [(doc[i], k, hashes[i], none[i], tokens[k * TILE : (k + 1) * TILE]) for k in sorted(wanted[i]) if k * TILE < tokens.size]
            for k in range(0, len(rows), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[k : k + 4000], strict=True), kinds, strict=True)], names)


def grams(tokens: np.ndarray) -> np.ndarray:
    """64-bit hashes of every run of LEAST tokens."""
    if tokens.size < LEAST:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.view(np.uint64) * powers(_ODD, tokens.size), dtype=np.uint64)])
        return mix64((total[LEAST:] - total[:-LEAST]) * powers(_INVERSE, tokens.size + 1)[: tokens.size - LEAST + 1])


def verify(mine: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, last) of mine of at least LEAST tokens that are similar enough to a run of other, none within another.

    A run starts and ends at an edge of an unbroken stretch that other holds too; all pairs of edges are tried whose numbers of
    equal and strange tokens could suffice, the longest first.  Runs of which each LEAST tokens occur in other belong always.
    """
    if mine.size == other.size and mine.size >= LEAST and (mine == other).all():
        return [(0, mine.size - 1)]
    at = np.flatnonzero(np.isin(mine, other))
    if not at.size:
        return []
    order = np.argsort(other, kind="stable")
    ordered = other[order]
    low, high = np.searchsorted(ordered, mine[at]), np.searchsorted(ordered, mine[at], side="right")
    once = high - low == 1
    shift = int(np.median((order[low] - at)[once] if once.any() else order[low] - at))
    # Of a token's places in other, the one nearest to the usual difference.
    key = low.astype(np.int64) * other.size
    near = np.searchsorted(np.searchsorted(ordered, ordered) * other.size + order, key + np.clip(at + shift, 0, other.size - 1))
    left, right = np.clip(near - 1, low, high - 1), np.clip(near, low, high - 1)
    place = np.where(np.abs(order[left] - at - shift) <= np.abs(order[right] - at - shift), order[left], order[right])

    exact = np.flatnonzero(np.isin(grams(mine), grams(other)))
    out = [(int(r[0]), int(r[-1]) + LEAST - 1) for r in _runs(exact, 0) if r.size]
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(place) != 1)) + 1
    begin, end = np.append(0, cut), np.append(cut, at.size) - 1
    equal = np.zeros(mine.size, bool)
    equal[at] = True
    before, there_before = _before(mine), _before(other)
    done = -1
    for i in begin.tolist():
        far = end[(end >= i) & (at[end] > done) & (at[end] - at[i] + 1 >= LEAST)]
        if not far.size:
            continue
        new = before[at[i] :] < at[i]
        here, same = (np.cumsum(x)[at[far] - at[i]] for x in (new, new & equal[at[i] :]))
        for p, q in ((place[i], place[far]), (max(at[i] + shift, 0), np.clip(at[far] + shift, 0, other.size - 1))):
            if p >= other.size:
                continue
            there = np.cumsum(there_before[p:] < p)[np.maximum(q - p, 0)]
            # No more than these are equal; only where this would do they are counted.
            for k in np.flatnonzero((q >= p) & (at[far] > done) & (same >= SIMILAR * (here + there - same)))[::-1].tolist():
                both = np.intersect1d(mine[at[i] : at[far[k]] + 1], other[p : q[k] + 1]).size
                if both >= SIMILAR * (here[k] + there[k] - both):
                    done = int(at[far[k]])
                    out.append((int(at[i]), done))
                    break
    return _outer(out)


#: Unbroken stretches up to which pairs of texts are verified together.
_BROKEN = 64


def verify_all(mine: list[np.ndarray], other: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """verify() of pairs of 32-bit tokens.  Those whose tokens occur once in each and come in the same order are done at once: there
    the equal tokens of a run and its partner are the ones between their edges, and all pairs of edges are tried."""
    n, size, there = len(mine), *(np.array([x.size for x in t], np.int64) for t in (mine, other))
    if not there.sum():
        return [[] for _ in mine]
    of, to = np.repeat(np.arange(n), size), np.repeat(np.arange(n), there)
    here, held = (k << 32 | np.concatenate(t) & 0xFFFFFFFF for k, t in ((of, mine), (to, other)))
    order = np.argsort(held, kind="stable")
    held, twice, ordered = held[order], np.zeros(n, bool), np.sort(here)
    for x in (held, ordered):
        twice[x[1:][x[1:] == x[:-1]] >> 32] = True
    found = np.minimum(np.searchsorted(held, here), held.size - 1)
    at = np.flatnonzero(held[found] == here)
    of, place = of[at], order[found[at]]
    at, place = at - (np.cumsum(size) - size)[of], place - (np.cumsum(there) - there)[of]
    twice[of[1:][(of[1:] == of[:-1]) & (place[1:] < place[:-1])]] = True
    edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (np.diff(at) != 1) | (np.diff(place) != 1)])[: at.size])
    twice |= np.bincount(of[edge], minlength=n) > _BROKEN
    out = [verify(mine[k], other[k]) if twice[k] else [] for k in range(n)]

    keep = ~twice[of]
    of, at, place = of[keep], at[keep], place[keep]
    if not of.size:
        return out
    # Half-way between the differences of places in order, as a median is.
    shifts, times = np.sort(of << 32 | (place - at + (1 << 31))) & 0xFFFFFFFF, np.bincount(of, minlength=n)
    begin = np.cumsum(times) - times
    middle = np.minimum(np.stack([begin + (times - 1) // 2, begin + times // 2]), of.size - 1)
    shift = np.trunc((shifts[middle] - (1 << 31)).sum(0) / 2).astype(np.int64)

    edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (np.diff(at) != 1) | (np.diff(place) != 1)]))
    end, times = np.append(edge[1:], of.size) - 1, np.bincount(of[edge], minlength=n)
    times = np.cumsum(times)[of[edge]] - np.arange(edge.size)
    i = np.repeat(np.arange(edge.size), times)
    j = end[np.arange(i.size) - np.repeat(np.cumsum(times) - times, times) + i]
    i = edge[i]
    long = at[j] - at[i] + 1 >= LEAST
    i, j = i[long], j[long]
    pair, own, equal = of[i], at[j] - at[i] + 1, j - i + 1
    fits = equal >= SIMILAR * (own + (place[j] - place[i] + 1) - equal)
    p, q = np.maximum(at[i] + shift[pair], 0), np.clip(at[j] + shift[pair], 0, there[pair] - 1)
    places = of << 32 | place
    equal = np.minimum(np.searchsorted(places, pair << 32 | q, side="right"), j + 1) - np.maximum(np.searchsorted(places, pair << 32 | p), i)
    fits |= (q >= p) & (equal >= SIMILAR * (own + (q - p + 1) - equal)) & (equal > 0)
    i, j = i[fits], j[fits]
    longest = np.append(i[1:] != i[:-1], True)[: i.size]
    i, j = i[longest], j[longest]
    ends = of[i] << 32 | at[j]
    outer = np.append(True, ends[1:] > np.maximum.accumulate(ends)[:-1])[: i.size]
    for k, a, b in zip(*(x[outer].tolist() for x in (of[i], at[i], at[j])), strict=True):
        out[k].append((a, b))
    return out


def _before(tokens: np.ndarray) -> np.ndarray:
    """The place of the last equal token before each; -1: none."""
    by, out = np.argsort(tokens, kind="stable"), np.full(tokens.size, -1)
    out[by[1:]] = np.where(tokens[by[1:]] == tokens[by[:-1]], by[:-1], -1)
    return out


def _outer(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that are within no other."""
    out, done = [], -1
    for first, last in sorted(set(runs), key=lambda x: (x[0], -x[1])):
        if last > done:
            out.append((first, last))
            done = last
    return out


def _runs(at: np.ndarray, gap: int) -> list[np.ndarray]:
    return np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1)


FOUND = "doc_id long, hash long, first_word long, end_word long, source_id long"


#: Tokens whose passages are verified at once.
_TOGETHER = 1 << 16


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: set[tuple] = set()
        held, size = [], 0

        def take() -> None:
            for (doc, h, source, a, *_), runs in zip(held, verify_all([x[4] for x in held], [x[5] for x in held]), strict=True):
                out.update((doc, h, a + first, a + last + SHINGLE, source) for first, last in runs)
            held.clear()

        for i in range(batch.num_rows):
            doc, source = batch.column("doc")[i].as_py(), batch.column("source")[i].as_py()
            parts = batch.column("parts")[i].values
            role, tile, hashes, none = (parts.field(n).to_pylist() for n in ("role", "tile", "hash", "none"))
            tokens, spans = parts.field("tokens"), next(x for x in parts.field("spans").to_pylist() if x)
            texts: tuple[dict, dict] = {}, {}
            for k in range(len(role)):
                texts[role[k]].setdefault((hashes[k], none[k]), {})[tile[k]] = tokens[k].values.to_numpy()
            for (h, no_id), mine in texts[0].items():
                for (_, no_source), other in texts[1].items():
                    for s in spans:
                        one, two_ = _joined(mine, s["a"], s["b"]), _joined(other, s["x"], s["y"])
                        held.append((None if no_id else doc, h, None if no_source else source, s["a"], one, two_))
                        size += one.size + two_.size
                        if size >= _TOGETHER:
                            take()
                            size = 0
        take()
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "hash", "first_word", "end_word", "source_id"])


def _joined(tiles: dict[int, np.ndarray], first: int, last: int) -> np.ndarray:
    """Tokens first..last as far as there are any."""
    at = [tiles[k] for k in range(first // TILE, last // TILE + 1) if k in tiles]
    return np.concatenate([*at, np.zeros(0, np.int32)])[first % TILE :][: last - first + 1].astype(np.int64)


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """FOUND: as repeated_passages(), with the text's hash, which tells apart rows of one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given, hashed = F.col(id_col).cast("long"), F.xxhash64(text)
    stand_in = hashed.bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    docs = df.select(F.coalesce(given, stand_in).alias("doc"), hashed.alias("hash"), given.isNull().alias("none"), text.alias("text"))
    dealt = docs.select("doc", "text").mapInArrow(_windows_of, DEALT).repartition("key").sortWithinPartitions("key", "near", "doc", "at")
    linked = written(dealt.mapInArrow(_links, LINK), "links")
    frequent = linked.where("doc = source").groupBy("doc").agg(F.collect_list(F.struct("at", F.col("sat").alias("key"))).alias("windows"))
    again = docs.join(frequent.hint("merge"), "doc").select("doc", "text", "windows").mapInArrow(_again, AGAIN)
    links = linked.where("doc <> source").union(again.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(_related, LINK))
    pairs = written(links.repartition("doc", "source").sortWithinPartitions("doc", "source", "at").mapInArrow(_pairs, PAIR).where(F.size("spans") > 0), "pairs")
    remove(linked)

    def of(role: int, key: str, first: str, last: str):
        tiles = lambda s: F.sequence(F.floor(s[first] / TILE).cast("int"), F.floor(s[last] / TILE).cast("int"))
        one = lambda s: F.transform(tiles(s), lambda t: F.struct(F.lit(role).alias("role"), F.col(key).alias("id"), t.alias("tile")))
        return F.flatten(F.transform("spans", one))

    members = F.array_distinct(F.concat(of(0, "doc", "a", "b"), of(1, "source", "x", "y")))
    members = pairs.select("doc", "source", "spans", F.posexplode(members).alias("pos", "m")).select("doc", "source", F.when(F.col("pos") == 0, F.col("spans")).alias("spans"), "m.*")
    wanted = members.groupBy(F.col("id").alias("doc")).agg(F.collect_set("tile").alias("tiles"))
    tiles = written(docs.join(wanted.hint("merge"), "doc").select("doc", "hash", "none", "text", "tiles").mapInArrow(_tiles_of, TILES), "tiles")
    parts = members.join(tiles.hint("merge"), ["id", "tile"]).groupBy("doc", "source").agg(F.collect_list(F.struct("role", "tile", "hash", "none", "tokens", "spans")).alias("parts"))
    found = written(parts.mapInArrow(_verified, FOUND), "passages")
    remove(pairs)
    remove(tiles)
    return found


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, end_word (exclusive), source_id: passages of doc_id that near-repeat one of source_id < doc_id."""
    return _found(df, id_col, text_col).select("doc_id", "first_word", "end_word", "source_id").distinct()


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, spans: list) -> str:
    """The text without the words of the spans (first, end), which may overlap."""
    at = [m.span() for m in _WORD.finditer(text)]
    parts, done = [], 0
    for first, end in sorted(spans):
        if first < len(at):
            a, b = at[first][0], at[min(end, len(at)) - 1][1]
            parts.append(text[done : max(a, done)])
            done = max(done, b)
    return "".join([*parts, text[done:]])


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with repeated passages taken out of the later documents; the first one keeps its own.  Rows all stay.

    Each row is cut by its own text's passages, also where several rows have one id or none.  length_col, if it is a column
    of whole numbers, becomes the new text's length; all other columns stay as they are, whatever their names.
    """
    own, hash_, spans = (free_name(n, df.columns) for n in ("own_id", "own_hash", "own_spans"))
    found = _found(df, id_col, text_col).groupBy(F.col("doc_id").alias(own), F.col("hash").alias(hash_)).agg(F.collect_set(F.struct("first_word", "end_word")).alias(spans))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(hash_))
    joined = df.join(found.hint("merge"), same, "left").drop(own, hash_)
    cols = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = [without(t, [(s["first_word"], s["end_word"]) for s in x]) if x and t else t for t, x in zip(batch.column(i).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            yield batch.set_column(i, text_col, pa.array(texts, batch.column(i).type)).select(cols)

    return length_updated(joined.mapInArrow(cut, df.schema), text_col, length_col)
