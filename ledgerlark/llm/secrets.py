"""Secret scans: all rules compiled into one minimal automaton, one pass over the bytes of a text.

The combined automaton finds where a match of any rule ends. Only there, the rule's own reversed
automaton walks back to where the match begins and its forward automaton on to where it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.automata import Dfa, compile_rules
from ledgerlark.llm.common import aside


class Rule(NamedTuple):
    """Matches that are shorter than `least`, or whose value (what follows `:` or `=`, blanks and a
    quote) is shorter than `value`, are dropped; their text is used up all the same."""

    kind: str
    pattern: str
    least: int = 0
    value: int = 0


#: Base rules first. Least lengths stand beside the patterns, since a counter that may begin anew
#: inside its own run multiplies the states; a run of [0-9a-f] cannot, so its length is in the pattern.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", value=6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
MASK = "[SECRET]"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        patterns = [r.pattern for r in rules]
        self.all = compile_rules(patterns, search=True)
        self.forward = [compile_rules([p]) for p in patterns]
        self.backward = [compile_rules([p], back=True) for p in patterns]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """Leftmost non-overlapping matches of each rule as (start, rule, end) in bytes, sorted."""
        dfa = self.all
        table, first, state = dfa.next, dfa.first, dfa.start
        done, found = [0] * len(self.rules), []
        for i, c in enumerate(data.translate(dfa.classes)):
            state = table[state + c]
            if state >= first:
                bits = dfa.accepts[state // dfa.width]
                for k, rule in enumerate(self.rules):
                    if bits >> k & 1 and done[k] <= i:
                        start = i + 1 - _reach(self.backward[k], data[done[k] : i + 1][::-1])
                        if start > i:  # it began inside an earlier match
                            continue
                        done[k] = start + _reach(self.forward[k], data, start)
                        match = data[start : done[k]]
                        if len(match) >= rule.least and (not rule.value or _value(match) >= rule.value):
                            found.append((start, k, done[k]))
        return sorted(found)


def _reach(dfa: Dfa, data: bytes, at: int = 0) -> int:
    """Length of the longest match that begins at `at`."""
    state, longest = dfa.start, 0
    table, classes = dfa.next, dfa.classes
    for n in range(at, len(data)):
        state = table[state + classes[data[n]]]
        if state >= dfa.first:
            longest = n + 1 - at
        elif state == dfa.dead:
            break
    return longest


def _value(match: bytes) -> int:
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    after = match[at + 1 :].lstrip(b" ")
    return len(after) - after.startswith((b'"', b"'"))


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then rule."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = scanner(rules).scan(data)
    if spans and len(data) != len(text):
        place = {b: len(data[:b].decode("utf-8", "surrogatepass")) for b in {x for s, _, e in spans for x in (s, e)}}
        spans = [(place[s], k, place[e]) for s, k, e in spans]
    return [(rules[k].kind, s, e) for s, k, e in spans]


def mask(text: str, spans: list[tuple[str, int, int]], by: str = MASK) -> str:
    """The text with each maximal run of overlapping spans replaced."""
    parts, at, end = [], 0, -1
    for _, s, e in spans:
        if s >= end:
            parts += [text[at:s], by] if end < 0 else [text[end:s], by]
            at = end = e
        end = max(end, e)
    return text if end < 0 else "".join([*parts, text[end:]])


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans, one row for each row of docs.

    Null text counts as empty. Texts are scanned whole, repeated rows alike; an empty table gives
    an empty result and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find(t.as_py(), rules) for t in batch.column(1)]
            base = [[x for x in s if x[0] in BASE] for s in spans]
            counts = [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *counts,
                    pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_digest(s) for s in spans], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = None, rules: tuple[Rule, ...] = RULES, by: str = MASK) -> DataFrame:
    """docs with every span in the text masked; null stays null, all other columns stay.

    n_chars: a column that holds the length of the text, set anew where a text was changed.
    """
    inner, names, back = aside(docs)
    at, size = names[text], names[n_chars] if n_chars else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            fresh = {at: [None if t is None else mask(t, find(t, rules), by) for t in old]}
            if size:
                fresh[size] = [len(new) if new != t else n for new, t, n in zip(fresh[at], old, batch.column(size).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fresh[f.name], f.type) if f.name in fresh else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return back(inner.mapInArrow(run, inner.schema))
