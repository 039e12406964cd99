"""Secret scans (operator 4): one combined deterministic automaton.

All rules are compiled together, by subset construction and minimisation, into
one transition table that reads each byte once and accepts where a rule's
shortest match ends. A text without such a place is done after that pass. In the others the table's accepting positions are
listed, and for each rule the leftmost start is found by the reverse automaton
and the longest end by the rule's own automaton, both over the found span only.

A rule is a head and a tail: matches are leftmost and don't overlap within
their kind, and a match whose measured part is too short is dropped after it
has used up its bytes. No rule's shortest match lies inside another of its own,
so the first position where one can end belongs to the leftmost match.

Defined results: a null or empty text has no spans; null and repeated ids each
keep their rows; an empty table gives no rows; other columns are ignored.
Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate
from operator import getitem
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Dfa, Nfa, parse
from .common import id_and_text, raw_bytes, slices


class Rule(NamedTuple):
    kind: str
    head: str
    tail: str  # a class; the match goes on as long as its bytes do
    least: int = 0  # of the tail if ``of_tail``, else of the match
    of_tail: bool = False
    any_case: bool = False
    first: int = 1  # tail bytes that the automaton waits for

    @property
    def shortest(self) -> str:
        return self.head + (f"{self.tail}{{{self.first}}}" if self.tail else "")

    @property
    def whole(self) -> str:
        return self.head + (f"{self.tail}{{{self.first},}}" if self.tail else "")


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 8, True, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 32, first=6),  # shorter runs would be dropped anyhow; six keep the automaton small
)
ADDED = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 15),
    Rule("google", "AIza", "[0-9A-Za-z_-]", 39),
    Rule("stripe", "sk_(live|test)_", "[0-9A-Za-z]", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 20),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", ""),
)

_TAIL_BYTES = bytes(range(0x80, 0xC0))


class Scanner:
    """The combined automaton of some rules, and each rule's own three for its spans."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + ADDED):
        self.rules = rules
        nfa, starts, tags = Nfa(), [], {}
        for k, r in enumerate(rules):
            _, first, last = parse(r.shortest, r.any_case, nfa)
            starts.append(first)
            tags[last] = k
        self.dfa = Dfa(nfa, starts, tags, loop=True)
        self.rows, self.found = _linked(self.dfa)
        self.parts = []
        for r in rules:
            one, first, last = parse(r.whole, r.any_case)
            whole, back = Dfa(one, [first], {last: 0}), Dfa(one.reversed(), [last], {first: 0})
            two, a, b = parse(r.head, r.any_case)
            self.parts.append((whole, back, Dfa(two, [a], {b: 0})))

    def may_match(self, text: bytes) -> bool:
        """The one pass: whether any rule can end anywhere."""
        return reduce(getitem, text.translate(self.dfa.classes), self.found[0]) is self.found[1]

    def ends(self, text: bytes) -> list[tuple[int, frozenset[int]]]:
        states = accumulate(text.translate(self.dfa.classes), getitem, initial=self.rows[0])
        return [(i, row[-1]) for i, row in enumerate(states) if row[-1]]

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule."""
        if not self.may_match(text):
            return []
        out, free = [], [0] * len(self.rules)
        for at, rules in self.ends(text):
            for k in rules:
                if at <= free[k]:
                    continue
                whole, back, head = self.parts[k]
                start = _furthest(back, text, range(at - 1, free[k] - 1, -1))
                if not start:
                    continue
                a = at - start
                b = a + _furthest(whole, text, range(a, len(text)))
                free[k] = b
                r = self.rules[k]
                measured = b - a - (_furthest(head, text, range(a, b)) if r.of_tail else 0)
                if measured >= r.least:
                    out.append((a, k, b))
        return sorted(out)


def _furthest(dfa: Dfa, text: bytes, places: range) -> int:
    """How many bytes of ``places`` the longest accepted run takes."""
    state, best, dead = 0, 0, dfa.dead()
    for n, i in enumerate(places, 1):
        state = dfa.table[state][dfa.classes[text[i]]]
        if state == dead:
            break
        if dfa.accepts[state]:
            best = n
    return best


def _linked(dfa: Dfa):
    """The table as rows that hold the next rows, so that a step is one index.
    The last entry of a row tells the rules that end. The second value has the
    start and the accepting state of a copy in which acceptance is for good."""
    width = len(dfa.table[0])
    rows = [[None] * width + [accept] for accept in dfa.accepts]
    hold: list = []
    hold += [hold] * width
    sticky = [hold if accept else [None] * width for accept in dfa.accepts]
    for s, targets in enumerate(dfa.table):
        rows[s][:width] = [rows[t] for t in targets]
        if not dfa.accepts[s]:
            sticky[s][:] = [sticky[t] for t in targets]
    return rows, (sticky[0], hold)


@lru_cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One for each Python worker."""
    return Scanner(rules)


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    out, at, points = [], 0, 0
    place = {}
    for i in sorted({x for a, _, b in spans for x in (a, b)}):
        points += len(text[at:i].translate(None, _TAIL_BYTES))
        at = i
        place[i] = points
    for a, k, b in spans:
        out.append((place[a], k, place[b]))
    return out


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """One row for each document: counts and digest of the base rules' spans, and the spans of all rules."""
    rules = BASE + added

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in slices(batches):
            rows = []
            for text in raw_bytes(batch.column("text")):
                spans = code_points(text, own.spans(text))
                shown = [(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in spans]
                base = ",".join(x for k, x in shown if k < len(BASE))
                counts = [sum(k == i for k, _ in shown) for i in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in shown)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FOUND.split(", ")])

    return id_and_text(docs).mapInArrow(each, FOUND)
