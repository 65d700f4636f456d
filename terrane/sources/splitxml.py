"""Large GML files in ranges of bytes, each range read by a task of its own.

A member may be cut out where its tags stand in text, not in a comment, a CDATA section or an instruction.  Each range first
tells, for each state that it may begin in, the state it ends in and how many members it opens and leaves open; put one after
the other these tell every range how it begins.  Then each range decodes the members whose tags begin in it, reading on past its
end for the last of them, under the document's own declaration.

Left to be decoded whole: files with a document type, in encodings of more than one byte a letter but UTF-8, and those with the
plural featureMembers, all of whose features lie in one element.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window, functions as F

from terrane import errors
from terrane.sources import files

TEXT, COMMENT, CDATA, INSTRUCTION = range(4)
_OPENS = {b"<!--": COMMENT, b"<![CDATA[": CDATA, b"<?": INSTRUCTION}
_CLOSES = {b"-->": COMMENT, b"]]>": CDATA, b"?>": INSTRUCTION}
_TOKEN = re.compile(rb"<!--|-->|<!\[CDATA\[|\]\]>|<\?|\?>|</?gml:featureMembers?(?=[\s/>])")
_TAG_END = re.compile(rb"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["'][^>]*\?>""")
#: Bytes read past a range's end for its last tag, and of members that are parsed together.
MORE, TOGETHER, HEAD = 1 << 16, 1 << 20, 1 << 16


def walk(data: bytes, state: int, depth: int, end: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(event, place, state, depth): start and end of outermost members, places after an end tag; then stop.

    Tokens that begin at `end` or later are not looked at.
    """
    for m in _TOKEN.finditer(data):
        if end is not None and m.start() >= end:
            break
        token = m[0]
        if state != TEXT:
            state = TEXT if _CLOSES.get(token) == state else state
        elif token in _OPENS:
            state = _OPENS[token]
        elif token.endswith(b"s"):
            yield "plural", m.start(), state, depth
        elif token.startswith(b"<"):
            tag = _TAG_END.match(data, m.end())
            if not tag:
                break
            if token.startswith(b"</"):
                depth -= 1
                if depth == 0:
                    yield "end", tag.end(), state, depth
            else:
                if depth == 0:
                    yield "start", m.start(), state, depth
                if data[tag.end() - 2 : tag.end() - 1] == b"/":
                    if depth == 0:
                        yield "end", tag.end(), state, depth
                else:
                    depth += 1
    yield "stop", len(data), state, depth


def _summed(row: dict) -> Iterator[dict]:
    """For each state that the range may begin in: the state at its end, members opened less those closed; any plural one."""
    size = row["end"] - row["start"]
    data = files.read_range(row["path"], row["start"], size + MORE)
    after, opened, plural = [], [], False
    for state in range(4):
        for event, _, last, depth in walk(data, state, 0, size):
            plural |= event == "plural"
        after.append(last)
        opened.append(depth)
    yield row | {"after": after, "opened": opened, "plural": plural}


def _begun(row: dict) -> Iterator[dict]:
    """A file's ranges with the state and depth that each begins in."""
    state = depth = 0
    for r in row["ranges"]:
        yield {"path": row["path"], "k": r["k"], "start": r["start"], "end": r["end"], "state": state, "depth": depth}
        state, depth = r["after"][state], depth + r["opened"][state]
    if state or depth:
        raise errors.InvalidGml(f"{row['path']} ends within a member, a comment or a section")


def _headed(row: dict) -> Iterator[dict]:
    """Whether a file can be cut, by its beginning; the declaration that its members are read under."""
    head = files.read_range(row["path"], 0, HEAD)
    declared = _DECLARED.match(head.removeprefix(b"\xef\xbb\xbf"))
    encoding = declared[1].decode().lower() if declared else "utf-8"
    wide = head[:2] in (b"\xfe\xff", b"\xff\xfe") or b"\0" in head[:64]
    yield row | {"cut": not wide and b"<!DOCTYPE" not in head and encoding in ("utf-8", "us-ascii", "iso-8859-1"), "declaration": declared[0] if declared else b""}


def members(row: dict) -> Iterator[bytes]:
    """The members whose start tags begin in a range."""
    size, at = row["end"] - row["start"], None
    data = files.read_range(row["path"], row["start"], size + MORE)
    for event, place, *_ in walk(data, row["state"], row["depth"]):
        if event == "start":
            if place >= size:
                return
            at = place
        elif event == "end" and at is not None:
            yield data[at:place]
            at = None
    if at is None:
        return
    more = 4 * MORE
    while True:
        data = files.read_range(row["path"], row["start"] + at, more)
        if end := next((place for event, place, *_ in walk(data, TEXT, 0) if event == "end"), None):
            yield data[:end]
            return
        if len(data) < more:
            raise errors.InvalidGml(f"{row['path']} ends within a member")
        more *= 4


def documents(row: dict) -> Iterator[bytes]:
    """The range's members as documents of about TOGETHER bytes."""
    held, size = [], 0
    made = lambda: row["declaration"] + b"<members>" + b"".join(held) + b"</members>"
    for m in members(row):
        held.append(m)
        size += len(m)
        if size >= TOGETHER:
            yield made()
            held, size = [], 0
    if held:
        yield made()


class Split:
    """Files (path, length) in ranges of so many bytes; records: of a document's bytes."""

    def __init__(self, found: DataFrame, range_bytes: int, records: Callable[[bytes], Iterator[tuple]]):
        self.records = records
        heads = files.mapped(found.select("path", "length"), _headed, "path string, length long, cut boolean, declaration binary")
        each = heads.where("cut").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / range_bytes) - 1)).alias("k"))
        ranges = each.select("path", "k", (F.col("k") * range_bytes).alias("start"), F.least("length", (F.col("k") + 1) * range_bytes).alias("end"))
        summed = files.mapped(ranges, _summed, "path string, k long, start long, end long, after array<int>, opened array<long>, plural boolean")
        # One small row for each range of a file.
        per_file = summed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end", "after", "opened"))).alias("ranges"), F.bool_or("plural").alias("plural"))
        self.kinds = heads.join(per_file.select("path", "plural"), "path", "left").select("path", (F.col("cut") & ~F.coalesce("plural", F.lit(False))).alias("cut"), "declaration")
        begun = files.mapped(per_file.where("not plural").select("path", "ranges"), _begun, "path string, k long, start long, end long, state int, depth long")
        self.ranges = begun.join(heads.select("path", "declaration"), "path")

    def others(self) -> DataFrame:
        """Paths of the files that are left to be decoded whole."""
        return self.kinds.where("not cut").select("path")

    def read(self) -> DataFrame:
        """The records of the files that are cut.  Their numbers take a first pass that counts the records of each range."""
        records = self.records

        def each(row: dict) -> Iterator[tuple]:
            for document in documents(row):
                yield from records(document)

        def count(row: dict) -> Iterator[dict]:
            yield {"path": row["path"], "k": row["k"], "n": sum(1 for _ in each(row))}

        before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        counts = files.mapped(self.ranges, count, "path string, k long, n long")
        firsts = counts.select("path", "k", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("first"))
        return files.decoded(files.dealt(self.ranges.join(firsts, ["path", "k"])), each)
