"""Large GeoJSON collections in ranges of bytes, each range read by a task of its own.

Whether a byte lies within a string, and how deep in brackets, depends on all bytes before it.  Each range first counts its
quotes, and its brackets for either case of its beginning; running sums over the ranges of a file then tell every range how it
begins.  A second look finds the root's members, and with them the list of features; a third one cuts the features that begin
in a range, reading on past its end for the last of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from terrane import errors
from terrane.sources import files

QUOTE, BACKSLASH, COMMA = 34, 92, 44
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[91, 123]] = _CLOSE[[93, 125]] = True
_MARKS = _OPEN | _CLOSE
_MARKS[COMMA] = True
#: Bytes read at a time past a range's end, and before its beginning; features and bytes of one row.
MORE, BACK, ROW, ROW_BYTES = 1 << 20, 1 << 10, 500, 4 << 20


def _quotes(b: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of quotes that begin or end a string; escaped: an odd number of backslashes stands right before b."""
    at = np.flatnonzero(b == QUOTE)
    slashes, alive, k = np.zeros(at.size, np.int64), np.arange(at.size), 1
    while alive.size:
        p = at[alive] - k
        slashes[alive[p < 0]] += escaped
        alive = alive[(p >= 0) & (b[np.maximum(p, 0)] == BACKSLASH)]
        slashes[alive] += 1
        k += 1
    return at[slashes % 2 == 0]


def _marks(b: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Places of brackets and commas outside of strings."""
    at = np.flatnonzero(_MARKS[b])
    return at[(np.searchsorted(quotes, at) + inside) % 2 == 0]


def _steps(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _OPEN[b[at]].astype(np.int64) - _CLOSE[b[at]]


def _before(path: str, at: int, wanted: Callable[[bytes], bool]) -> bytes:
    """The bytes before a place, as many as wanted() needs to be true, or all."""
    size = BACK
    while True:
        found = files.read_range(path, max(at - size, 0), min(size, at))
        if size >= at or wanted(found):
            return found
        size *= 4


def _escaped(path: str, at: int) -> bool:
    found = _before(path, at, lambda x: bool(x.rstrip(b"\\")))
    return (len(found) - len(found.rstrip(b"\\"))) % 2 == 1


def _named_features(path: str, at: int) -> bool:
    """Whether the list that begins at a place is the value of a key features."""
    enough = lambda x: bool(y := x.rstrip()) and (y[-1:] != b":" or len(y[:-1].rstrip()) > 10)
    key = _before(path, at, enough).rstrip()
    return key[-1:] == b":" and key[:-1].rstrip()[-10:] == b'"features"' and key[:-1].rstrip()[-11:-10] != b"\\"


class _Range:
    """A range's bytes with its marks: at, their places within; depth, after each; inside, whether its end lies in a string."""

    def __init__(self, path: str, start: int, end: int, inside: bool, depth: int, escaped: bool | None = None):
        self.path, self.start, self.end = path, start, end
        self.b = np.frombuffer(files.read_range(path, start, end - start), np.uint8)
        quotes = _quotes(self.b, _escaped(path, start) if escaped is None else escaped)
        self.at = _marks(self.b, quotes, inside)
        self.depth = depth + np.cumsum(_steps(self.b, self.at))
        self.inside = bool((quotes.size + inside) % 2)
        self.last = int(self.depth[-1]) if self.at.size else depth


def _counted(row: dict) -> Iterator[dict]:
    b = np.frombuffer(files.read_range(row["path"], row["start"], row["end"] - row["start"]), np.uint8)
    quotes = _quotes(b, _escaped(row["path"], row["start"]))
    outside, within = (int(_steps(b, _marks(b, quotes, inside)).sum()) for inside in (False, True))
    yield row | {"quotes": int(quotes.size), "outside": outside, "within": within}


def _rooted(row: dict) -> Iterator[dict]:
    """The root's own text in this range, what its members hold left out, and whether the last list that begins in it is the features'."""
    r = _Range(row["path"], row["start"], row["end"], row["inside"], row["depth"])
    step = _steps(r.b, r.at)
    opened, closed = r.at[(step > 0) & (r.depth == 2)], r.at[(step < 0) & (r.depth == 1)]
    edges = np.sort(np.concatenate([opened + 1, closed]))  # root's text ends after an opening bracket and goes on with the closing one
    edges = np.concatenate([[0] if row["depth"] <= 1 else [], edges]).astype(np.int64)
    edges = np.concatenate([edges, [r.b.size] if edges.size % 2 else []]).astype(np.int64)
    text = b"".join(r.b[a:z].tobytes() for a, z in zip(edges[::2], edges[1::2], strict=False))
    lists = opened[r.b[opened] == 91]
    named = _named_features(r.path, r.start + int(lists[-1])) if lists.size and lists[-1] == opened[-1] else False
    yield row | {"text": text, "listed": named if opened.size else None, "left": r.last + 2 * r.inside}


def _cut(row: dict) -> Iterator[bytes]:
    """The members of the features' list that begin in a range."""
    r = _Range(row["path"], row["start"], row["end"], row["inside"], row["depth"])
    step, listed, begun, pieces = _steps(r.b, r.at), bool(row["listed"]), None, []
    chosen = np.flatnonzero((r.depth == 2) & ((step > 0) | (r.b[r.at] == COMMA)) | (r.depth == 1) & (step < 0))
    for i in chosen.tolist():
        at, opens, closes = int(r.at[i]), step[i] > 0, step[i] < 0
        if begun is not None:
            yield r.b[begun:at].tobytes()
        begun = None
        if opens:
            listed = r.b[at] == 91 and _named_features(r.path, r.start + at)
        if listed and not closes:
            begun = at + 1
    if begun is None:
        return
    pieces = [r.b[begun:].tobytes()]
    size = files.size_of(r.path)
    while r.end < size:
        tail = len(pieces[-1]) - len(pieces[-1].rstrip(b"\\"))
        r = _Range(r.path, r.end, min(r.end + MORE, size), r.inside, r.last, tail % 2 == 1 if tail < len(pieces[-1]) else None)
        step = _steps(r.b, r.at)
        ends = r.at[(r.depth == 2) & (r.b[r.at] == COMMA) | (r.depth == 1) & (step < 0)]
        if ends.size:
            yield b"".join([*pieces, r.b[: ends[0]].tobytes()])
            return
        pieces.append(r.b.tobytes())
    raise errors.InvalidGeoJson(f"{r.path} ends within its features")


def _n_records(member: bytes) -> int:
    if b'"MultiPolygon"' not in member:
        return 1
    try:
        geometry = json.loads(member).get("geometry") or {}
        return len(geometry["coordinates"]) if geometry.get("type") == "MultiPolygon" else 1
    except (AttributeError, KeyError, TypeError, ValueError):
        return 1  # decoding it will tell what is wrong


def _members(row: dict) -> Iterator[tuple[int, str]]:
    """(number of records, text) of each member; a list without any has blanks only."""
    for member in _cut(row):
        if member.strip():
            yield _n_records(member), member.decode("utf-8", "replace")


def _cut_rows(row: dict) -> Iterator[dict]:
    first, held, size, count = row["first"], [], 0, 0
    for n, text in _members(row):
        held.append(text)
        size, count = size + len(text), count + n
        if len(held) == ROW or size >= ROW_BYTES:
            yield {"path": row["path"], "first": first, "features": held}
            held, size, count, first = [], 0, 0, first + count
    if held:
        yield {"path": row["path"], "first": first, "features": held}


def _count_rows(row: dict) -> Iterator[dict]:
    yield {"path": row["path"], "k": row["k"], "n": sum(n for n, _ in _members(row))}


_RANGE = "path string, k long, start long, end long"


class Split:
    """Files (path, length) in ranges of so many bytes."""

    def __init__(self, found: DataFrame, range_bytes: int):
        n = F.ceil(F.col("length") / range_bytes)
        each = found.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
        ranges = each.select("path", "k", (F.col("k") * range_bytes).alias("start"), F.least("length", (F.col("k") + 1) * range_bytes).alias("end"))
        before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        counted = files.mapped(ranges, _counted, f"{_RANGE}, quotes long, outside long, within long")
        inside = counted.select("path", "k", "start", "end", "outside", "within", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
        depth = F.coalesce(F.sum(F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))).over(before), F.lit(0))
        begun = inside.select("path", "k", "start", "end", "inside", depth.alias("depth"))
        rooted = files.mapped(begun, _rooted, f"{_RANGE}, inside boolean, depth long, text binary, listed boolean, left long")
        self.ranges = rooted.withColumn("listed", F.last("listed", True).over(before))
        # The root's own text is small: what its members hold is left out.
        pieces = rooted.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t"), F.max_by("left", "k").alias("left"))
        text = F.array_join(F.transform("t", lambda x: x["text"].cast("string")), "")
        root = pieces.select("path", "left", F.from_json(text, "type string, features string").alias("root"))
        broken = F.raise_error(F.concat(F.lit("InvalidGeoJson: unbalanced brackets or quotes in "), "path"))
        self.kinds = root.select("path", F.when(F.col("left") != 0, broken).otherwise((F.col("root.type") == "FeatureCollection") & F.startswith("root.features", F.lit("["))).alias("collection"))

    def others(self) -> DataFrame:
        """Paths of files that hold no collection, to be decoded whole."""
        return self.kinds.where(~F.coalesce("collection", F.lit(False))).select("path")

    def features(self) -> DataFrame:
        """path, first (number of the first record) and features (texts) of the collections, some features a row."""
        ours = self.ranges.join(self.kinds.where("collection").select("path"), "path").drop("text", "left")
        counts = files.mapped(ours, _count_rows, "path string, k long, n long")
        before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        firsts = counts.select("path", "k", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("first"))
        return files.mapped(ours.join(firsts, ["path", "k"]), _cut_rows, "path string, first long, features array<string>")
