"""Rule expressions compiled into one deterministic automaton over bytes.

The syntax: literals, \\-escapes of single characters, \\xHH, classes with ranges and ^, groups (capturing or (?:...)),
|, ?, *, +, {m}, {m,} and {m,n}.  Everything is over bytes.
"""

from __future__ import annotations

import numpy as np

EMPTY = ("seq", ())


class _Parser:
    def __init__(self, text: str, either_case: bool):
        self.text, self.at, self.fold = text, 0, either_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.text[self.at]
        self.at += 1
        return c

    def either(self):
        branches = [self.run()]
        while self.peek() == "|":
            self.take()
            branches.append(self.run())
        return branches[0] if len(branches) == 1 else ("or", tuple(branches))

    def run(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("seq", tuple(parts))

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                low, high = int(low), (int(high) if high else None) if comma else int(low)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tail = (("star", node),) if high is None else ()
            optional = EMPTY
            for _ in range((high or low) - low):
                optional = ("or", (EMPTY, ("seq", (node, optional))))
            node = ("seq", (node,) * low + tail + (optional,))
        return node

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self):
        if self.peek() == "(":
            self.take()
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self.either()
            self.take()
            return node
        if self.peek() != "[":
            return self.set({self.byte()})
        self.take()
        negated = self.peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                found.update(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.take()
        return self.set(set(range(256)) - found if negated else found)

    def set(self, found: set[int]):
        if self.fold:
            found = found | {b ^ 32 for b in found if 65 <= (b & ~32) <= 90}
        return ("set", frozenset(found))


def parse(text: str, either_case: bool = False):
    return _Parser(text, either_case).either()


def mirrored(node):
    """The expression of the reversed strings."""
    kind, x = node
    if kind == "seq":
        return ("seq", tuple(mirrored(n) for n in reversed(x)))
    if kind == "or":
        return ("or", tuple(mirrored(n) for n in x))
    return ("star", mirrored(x)) if kind == "star" else node


class _Nfa:
    def __init__(self):
        self.skip: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def new(self) -> int:
        self.skip.append([])
        self.step.append(None)
        return len(self.skip) - 1

    def add(self, node, start: int) -> int:
        """Builds node from state start; returns its end state."""
        kind, x = node
        if kind == "set":
            end = self.new()
            self.step[start] = (x, end)
            return end
        if kind == "seq":
            for n in x:
                between = self.new()
                self.skip[start].append(between)
                start = self.add(n, between)
            return start
        end = self.new()
        if kind == "or":
            for n in x:
                first = self.new()
                self.skip[start].append(first)
                self.skip[self.add(n, first)].append(end)
        else:
            loop, first = self.new(), self.new()
            self.skip[start].append(loop)
            self.skip[loop] += [first, end]
            self.skip[self.add(x, first)].append(loop)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """The minimal deterministic automaton of several expressions.

    step[state * classes + kind[byte]] is the next state's row (state * classes); accepts[row] is a bit mask of the
    expressions that end there.  floating: a match may begin at any byte; otherwise only at the first, and -1 means that
    no match can follow.  Rows from `first_hit` on accept something.
    """

    def __init__(self, nodes: list, floating: bool):
        nfa = _Nfa()
        root, ends = nfa.new(), {}
        for k, node in enumerate(nodes):
            first = nfa.new()
            nfa.skip[root].append(first)
            ends[nfa.add(node, first)] = 1 << k
        sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.kind = bytes(kinds[s] for s in signature)
        self.classes = n = len(kinds)
        sample = [signature.index(s) for s in kinds]
        begin = nfa.closed([root])
        rows, table, todo = {begin: 0}, [], [begin]
        for now in todo:
            row = []
            for b in sample:
                to = nfa.closed([t for s in now if nfa.step[s] and b in nfa.step[s][0] for t in [nfa.step[s][1]]])
                to = to | begin if floating else to
                if not to:
                    row.append(-1)
                    continue
                if to not in rows:
                    rows[to] = len(rows)
                    todo.append(to)
                row.append(rows[to])
            table.append(row)
        table = np.array(table).reshape(-1, n)
        mask = np.array([sum(ends.get(s, 0) for s in now) for now in todo])
        # Minimisation: states stay together while their masks and their successors' groups agree.
        group = np.unique(mask, return_inverse=True)[1]
        while True:
            key = np.column_stack([group, np.where(table < 0, -1, group[table])])
            finer = np.unique(key, axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        some = np.unique(group, return_index=True)[1]
        order = np.argsort(mask[some] > 0, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        to = table[some[order]]
        to = np.where(to < 0, -1, place[group[to]] * n)
        self.start = int(place[group[0]]) * n
        self.step = to.ravel().tolist()
        self.accepts = {i * n: int(m) for i, m in enumerate(mask[some[order]]) if m}
        self.first_hit = min(self.accepts, default=len(self.step))
