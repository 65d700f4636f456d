"""Secret scanning by one automaton for all rules.

All rules are compiled together into a minimal deterministic automaton; each text's bytes pass through it once, and the
positions at which it accepts give the ends of each rule's matches.  The start of a match is found from its end by the
automaton of the reversed rule.  Matches are the leftmost, longest, non-overlapping ones of each rule.  A last check
(a group's or the match's length) may then drop a match, which has still used up its characters.  A rule's tail, an
expression of re, carries a match on from its end.

Null and empty texts have no spans.  Work is row-local: nothing is shuffled, repeated rows get equal spans, an empty table gives
none, other columns take no part, and texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.automaton import Automaton, mirrored, parse
from terrane.llm.common import as_bytes, length_updated, two


#: What a rule's match stands alone from.
_INNER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"


@dataclass(frozen=True)
class Rule:
    """pattern: the syntax of terrane.llm.automaton, also that of re.  group and least: the length asked of a group.
    tail: what belongs to a match after the pattern, in re's own syntax; without it there is no match.  With a tail, least is
    the whole match's length.  alone: no ASCII letter, digit or underscore stands right before a match.  holds: what the tail,
    or else the match, has to have in it, so that prose isn't taken for a key."""

    kind: str
    pattern: str
    either_case: bool = False
    group: int = 0
    least: int = 0
    tail: str = ""
    alone: bool = True
    holds: str = ""


#: What follows a private key's first line: fields (Proc-Type: ...), then base64 as far as the last line, also within quotes
#: and comments.  Without a last line (a key cut off): whole lines of base64, and words of 16 or more of its characters.
_LINE = r"(?:[ \t]*+(?:[\r\n]|\\[nr]))"
_FIELDS = rf"(?:{_LINE}++[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+"
_WHOLE = r"""[A-Za-z0-9+/=\s"'`>#*,;|\\]*+-----END [A-Z ]*PRIVATE KEY-----"""
_CUT_OFF = rf"(?:{_LINE}++[ \t]*+[A-Za-z0-9+/=]++(?={_LINE}|[ \t]*\Z)|(?:\s|\\[nrt])*+[A-Za-z0-9+/=]{{16,}}+)++"
_KEY = f"(?:{_FIELDS}(?:{_WHOLE}|{_CUT_OFF}))?"

#: The base rules, then those added, in the order in which spans of one start are listed.  Lengths are checked after the
#: pass: a counted repetition that overlaps other rules would multiply the automaton's states, as would more rules with long open tails of shared characters.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, alone=False),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, alone=False),
    Rule("hex", r"[0-9a-f]{24,}", alone=False),
)
#: A digit, or letters of both cases.
_MIXED = r"[0-9]|[a-z][^\s]*[A-Z]|[A-Z][^\s]*[a-z]"
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=_KEY, alone=False),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+", least=40, holds=_MIXED),
    # The automaton tells where these begin; how they go on is matched from there, so open tails don't multiply its states.
    Rule("slack", r"xox[abprs]-", tail=r"[A-Za-z0-9-]*+", least=20, holds=_MIXED),
    Rule("slack_hook", r"hooks.slack.com/services/", tail=r"[A-Za-z0-9/]*+", least=60, holds=_MIXED),
    Rule("stripe", r"[rs]k_(live|test)_", tail=r"[A-Za-z0-9]*+", least=24, holds=_MIXED),
    Rule("google_key", r"AIza", tail=r"[A-Za-z0-9_-]*+", least=39, holds=_MIXED),
    Rule("google_token", r"ya29.", tail=r"[A-Za-z0-9_-]*+", least=40, holds=_MIXED),
    Rule("aws_session", r"ASIA", tail=r"[A-Z0-9]*+", least=20),
    Rule("gitlab", r"glpat-", tail=r"[A-Za-z0-9_-]*+", least=26, holds=_MIXED),
    Rule("npm", r"npm_", tail=r"[A-Za-z0-9]*+", least=40, holds=_MIXED),
    Rule("pypi", r"pypi-AgE", tail=r"[A-Za-z0-9_-]*+", least=50, holds=_MIXED),
    Rule("model_hub", r"hf_", tail=r"[A-Za-z0-9]*+", least=37, holds=_MIXED),
    Rule("model_api", r"sk-", tail=r"[A-Za-z0-9_-]*+", least=40, holds="[0-9]"),
    Rule("mail_api", r"SG.", tail=r"[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+", holds=_MIXED),
    Rule("web_token", r"eyJ", tail=r"[A-Za-z0-9_-]{6,}+\.eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]*+", holds=_MIXED),
    Rule("droplet", r"do[opr]_v1_", tail=r"[0-9a-f]*+", least=60),
    Rule("shop", r"shp(at|ca|pa|ss)_", tail=r"[0-9a-fA-F]*+", least=38),
    Rule("phone_api", r"SK", tail=r"[0-9a-f]{32}(?![0-9a-f])"),
    Rule("bearer", r"[Bb]earer\x20", tail=r"(?=[A-Za-z_.=+/-]*[0-9])[A-Za-z0-9_.=+/-]*+", least=27),
    Rule("basic", r"[Bb]asic\x20", tail=r"(?=[A-Za-z+/]*[0-9=])[A-Za-z0-9+/]{16,}+={0,2}"),
    Rule("login", r"://", tail=r"""[^\s/:@"'<>]++:[^\s/@"'<>]{3,}+@""", alone=False),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + ADDED):
        self.rules = rules
        nodes = [parse(r.pattern, r.either_case) for r in rules]
        self.forward = Automaton(nodes, floating=True)
        self.backward = [Automaton([mirrored(n)], floating=False) for n in nodes]
        self.exact = [re.compile(r.pattern.encode(), re.I if r.either_case else 0) for r in rules]
        self.tails = [r.tail and re.compile(r.tail.encode()) for r in rules]
        self.holds = [r.holds and re.compile(r.holds.encode()) for r in rules]

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(end, state) wherever something is accepted: the one pass over the bytes."""
        step, first, state, found = self.forward.step, self.forward.first_hit, self.forward.start, []
        for at, kind in enumerate(data.translate(self.forward.kind), 1):
            state = step[state + kind]
            if state >= first:
                found.append((at, state))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule's index) in bytes, by start, then rule."""
        hits = self.hits(data)
        if not hits:
            return []
        found = []
        accepts = self.forward.accepts
        for k, rule in enumerate(self.rules):
            ends = [end for end, state in hits if accepts[state] >> k & 1]
            used, i = 0, 0
            while i < len(ends):
                low = ends[i]
                while i + 1 < len(ends) and ends[i + 1] == ends[i] + 1:
                    i += 1
                high = ends[i]
                i += 1
                start = self.began(k, data, low, used)
                if start < 0:  # what ends at low began before the last match's end; another may begin after that
                    again = [used + at for at, state in self.hits(data[used:high]) if accepts[state] >> k & 1]
                    if not again or (start := self.began(k, data, again[0], used)) < 0:
                        continue
                if rule.alone and data[start - 1 : start].translate(None, _INNER) != data[start - 1 : start]:
                    continue
                body = start
                if self.tails[k]:
                    body = high
                    if not (on := self.tails[k].match(data, high)):
                        continue
                    high = on.end()
                    while i < len(ends) and ends[i] <= high:
                        i += 1
                if self.holds[k] and not self.holds[k].search(data, body, high):
                    continue
                used = high
                if high - start >= rule.least if rule.tail or not rule.least else (m := self.exact[k].fullmatch(data, start, high)) and len(m[rule.group]) >= rule.least:
                    found.append((start, high, k))
        return sorted(found)

    def began(self, k: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start, not before least, of a match of rule k that ends at end; -1: none."""
        a, start = self.backward[k], -1
        state = a.start
        for at in range(end - 1, least - 1, -1):
            state = a.step[state + a.kind[data[at]]]
            if state < 0:
                break
            if state >= a.first_hit:
                start = at
        return start


@cache
def scanner() -> Scanner:
    return Scanner()


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points; a start's bytes are counted on from the one before."""
    if data.isascii():
        return spans
    out, at, n = [], 0, 0
    for start, end, k in spans:
        n += len(data[at:start].decode("utf-8", "replace"))
        at = start
        out.append((n, n + len(data[start:end].decode("utf-8", "replace")), k))
    return out


SPANS = "array<struct<start:long,end:long,kind:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of start, end, kind; code points, end exclusive) for every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column("text")):
                rows.append([{"start": a, "end": b, "kind": s.rules[k].kind} for a, b, k in in_code_points(data, s.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPAN)], ["doc_id", "spans"])

    return two(df, id_col, text_col).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with every secret in the text replaced by [kind]; null texts stay null.

    length_col, if it is a column of whole numbers, becomes the new text's length; all others stay as they are.  Overlapping spans are replaced together, under the kind of the first.
    """
    cols = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            column = batch.column(text_col)
            out = []
            for data, there in zip(as_bytes(column), column.is_valid().to_pylist(), strict=True):
                if there and (spans := s.spans(data)):
                    parts, at = [], 0
                    for start, end, k in spans:
                        if start >= at:
                            parts += [data[at:start], b"[" + s.rules[k].kind.encode() + b"]"]
                        at = max(at, end)
                    data = b"".join([*parts, data[at:]])
                out.append(data)
            yield batch.set_column(cols.index(text_col), text_col, pa.array(out, pa.binary()).cast(column.type))

    return length_updated(df.mapInArrow(scan, df.schema), text_col, length_col)
