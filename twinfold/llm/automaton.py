"""Deterministic automata over bytes from a small regular-expression language.

Literals, ``\\xHH`` and ``\\c`` escapes, classes, groups, ``|``, ``? * +`` and
``{m}``, ``{m,}``, ``{m,n}``. An expression becomes a Thompson automaton, that a
deterministic one by subset construction, and that a minimal one by partition
refinement. Bytes that no rule tells apart share a column of the transition
arrays.
"""

from __future__ import annotations

from itertools import count

FULL = frozenset(range(256))


class Nfa:
    """Edges by state: on a set of bytes, or empty."""

    def __init__(self):
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.empty.append([])
        return len(self.on) - 1

    def reversed(self) -> Nfa:
        out = Nfa()
        for _ in self.on:
            out.state()
        for a, edges in enumerate(self.on):
            for label, b in edges:
                out.on[b].append((label, a))
        for a, targets in enumerate(self.empty):
            for b in targets:
                out.empty[b].append(a)
        return out


class _Parser:
    def __init__(self, pattern: str, nfa: Nfa, any_case: bool):
        self.p, self.i, self.nfa, self.any_case = pattern, 0, nfa, any_case

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def cased(self, label: set[int]) -> frozenset[int]:
        if self.any_case:
            label |= {b ^ 32 for b in label if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(label)

    def klass(self) -> frozenset[int]:
        self.i += 1
        negative = self.peek() == "^"
        self.i += negative
        label: set[int] = set()
        while self.peek() != "]":
            lo = hi = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                hi = self.char()
            label |= set(range(lo, hi + 1))
        self.i += 1
        label = set(self.cased(label))
        return frozenset(FULL - label if negative else label)

    # A node is a function (nfa) -> (first state, last state); repeats build it anew.
    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())

        def build():
            a, b = self.nfa.state(), self.nfa.state()
            for option in options:
                x, y = option()
                self.nfa.empty[a].append(x)
                self.nfa.empty[y].append(b)
            return a, b

        return build if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())

        def build():
            a = b = self.nfa.state()
            for part in parts:
                x, y = part()
                self.nfa.empty[b].append(x)
                b = y
            return a, b

        return build

    def repeat(self):
        atom = self.atom()
        while (c := self.peek()) and c in "?*+{":
            lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : end].partition(",")
                lo = int(low)
                hi = (int(high) if high else None) if comma else lo
                self.i = end
            self.i += 1
            atom = self.repeated(atom, lo, hi)
        return atom

    def repeated(self, atom, lo: int, hi: int | None):
        def build():
            a = b = self.nfa.state()
            for k in count():
                if hi is None and k == max(lo, 1) - 1 or hi is not None and k >= hi:
                    break
                x, y = atom()
                self.nfa.empty[b].append(x)
                end = self.nfa.state()
                self.nfa.empty[y].append(end)
                if k >= lo:
                    self.nfa.empty[b].append(end)
                b = end
            if hi is None:
                x, y = atom()
                end = self.nfa.state()
                self.nfa.empty[b].append(x)
                self.nfa.empty[y] += [x, end]
                if lo == 0:
                    self.nfa.empty[b].append(end)
                b = end
            return a, b

        return build

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            if self.p.startswith("?:", self.i):
                self.i += 2
            inner = self.either()
            self.i += 1
            return inner
        label = self.klass() if c == "[" else self.cased({self.char()})

        def build():
            a, b = self.nfa.state(), self.nfa.state()
            self.nfa.on[a].append((label, b))
            return a, b

        return build


def parse(pattern: str, any_case: bool = False, nfa: Nfa | None = None) -> tuple[Nfa, int, int]:
    nfa = nfa or Nfa()
    first, last = _Parser(pattern, nfa, any_case).either()()
    return nfa, first, last


class Dfa:
    """``classes`` maps bytes to columns, ``table[state][column]`` is the next
    state, ``accepts[state]`` the tags of the rules that end there. State 0 is
    the start."""

    def __init__(self, nfa: Nfa, starts: list[int], tags: dict[int, int], loop: bool = False):
        labels = {label for edges in nfa.on for label, _ in edges}
        by_signature: dict[tuple[bool, ...], int] = {}
        ordered = sorted(labels, key=sorted)
        self.classes = bytes(by_signature.setdefault(tuple(b in x for x in ordered), len(by_signature)) for b in range(256))
        width = len(by_signature)
        members = [next(b for b in range(256) if self.classes[b] == c) for c in range(width)]

        def closure(states) -> frozenset[int]:
            out, todo = set(states), list(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(out)

        begin = closure(starts)
        index, table, todo = {begin: 0}, [], [begin]
        for own in todo:  # grows as new subsets appear
            row = []
            for b in members:
                to = closure({t for s in own for label, t in nfa.on[s] if b in label})
                to = to | begin if loop else to
                if to not in index:
                    index[to] = len(todo)
                    todo.append(to)
                row.append(index[to])
            table.append(row)
        accepts = [frozenset(tags[s] for s in own if s in tags) for own in todo]
        self.table, self.accepts = _minimal(table, accepts)

    def dead(self) -> int:
        """The state that never accepts any more, or -1."""
        return next((s for s, row in enumerate(self.table) if not self.accepts[s] and all(t == s for t in row)), -1)


def _minimal(table: list[list[int]], accepts: list[frozenset[int]]):
    """Merge states that no continuation tells apart."""
    ids: dict = {}
    block = [ids.setdefault(a, len(ids)) for a in accepts]
    while True:
        ids = {}
        finer = [ids.setdefault((block[s], tuple(block[t] for t in row)), len(ids)) for s, row in enumerate(table)]
        if len(ids) == len(set(block)):
            break
        block = finer
    rank: dict[int, int] = {}
    for s in range(len(table)):
        rank.setdefault(block[s], len(rank))
    chosen = {}
    for s in range(len(table)):
        chosen.setdefault(rank[block[s]], s)
    return [[rank[block[t]] for t in table[chosen[k]]] for k in range(len(rank))], [accepts[chosen[k]] for k in range(len(rank))]
