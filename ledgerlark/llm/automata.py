"""Regular expressions to minimal deterministic automata over bytes.

Expressions are parsed by Python's own parser (sequences, alternatives, classes, repeats, groups
and `(?i:...)`), turned into a nondeterministic automaton, determinised by subset construction and
minimised by splitting classes of states. The result is a flat transition array: bytes map to
classes, `next[state + class]` is the next state, and states are numbered in steps of the number
of classes so that one addition finds the entry.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_parse = re._parser.parse  # type: ignore[attr-defined]
BYTES = 256


class Nfa:
    """States are numbers; `step[s]` is a list of (set of bytes, target), `free[s]` of targets without a byte."""

    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, tree, start: int, fold: bool, back: bool) -> int:
        """Build the parsed sequence from `start`; returns its end. back: for reversed text."""
        for op, arg in reversed(list(tree)) if back else list(tree):
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                end = self.state()
                self.step[start].append((_bytes(name, arg, fold), end))
            elif name == "SUBPATTERN":
                _, on, off, inner = arg
                end = self.add(inner, start, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE, back)
            elif name == "BRANCH":
                end = self.state()
                for inner in arg[1]:
                    first = self.state()
                    self.free[start].append(first)
                    self.free[self.add(inner, first, fold, back)].append(end)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                least, most, inner = arg
                end = start
                for _ in range(least):
                    end = self.add(inner, end, fold, back)
                if most is re._constants.MAXREPEAT:  # type: ignore[attr-defined]
                    loop = self.state()
                    self.free[end].append(loop)
                    self.free[self.add(inner, loop, fold, back)].append(loop)
                    end = loop
                else:
                    stops = [end]
                    for _ in range(most - least):
                        end = self.add(inner, end, fold, back)
                        stops.append(end)
                    last = self.state()
                    for s in stops:
                        self.free[s].append(last)
                    end = last
            else:
                raise ValueError(f"{name} is not supported")
            start = end
        return start


def _bytes(name: str, arg, fold: bool) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(BYTES)) - {10}
    found: set[int] = set()
    for op, value in [("LITERAL", arg)] if name in ("LITERAL", "NOT_LITERAL") else arg:
        kind = str(op)
        if kind == "LITERAL":
            found.add(value)
        elif kind == "RANGE":
            found.update(range(value[0], value[1] + 1))
        elif kind != "NEGATE":
            raise ValueError(f"{kind} is not supported in a class")
    if max(found, default=0) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {ord(chr(b).swapcase()) for b in found}
    negative = name == "NOT_LITERAL" or name == "IN" and str(arg[0][0]) == "NEGATE"
    return frozenset(range(BYTES)) - found if negative else frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """classes: a table for bytes.translate; accepts[state // width]: bits of the rules that end there.

    States whose number is at least `first` accept; `dead` is the state that nothing leaves, or -1.
    """

    classes: bytes
    next: tuple[int, ...]
    accepts: tuple[int, ...]
    width: int
    start: int
    first: int
    dead: int


def compile_rules(patterns: list[str], search: bool = False, back: bool = False) -> Dfa:
    """One automaton for all patterns. back: for reversed text.

    search: a match may begin at any byte, and is followed to the first byte at which it can end.
    So runs at the end of a rule cost no states, which else multiply over the rules.
    """
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for k, p in enumerate(patterns):
        first = nfa.state()
        nfa.free[root].append(first)
        ends[nfa.add(_parse(p), first, False, back)] = 1 << k

    # classes of bytes that no rule tells apart
    labels = sorted({s for steps in nfa.step for s, _ in steps}, key=sorted)
    signature = [tuple(b in s for s in labels) for b in range(BYTES)]
    kinds = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    classes = bytes(kinds[x] for x in signature)
    sample = [classes.index(i) for i in range(len(kinds))]

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    begin = closed([root])
    number, moves, queue = {begin: 0}, [], [begin]
    for now in queue:
        row = []
        for b in sample:
            then = closed({t for s in now if not (search and s in ends) for on, t in nfa.step[s] if b in on})
            if search:
                then |= begin
            if then not in number:
                number[then] = len(number)
                queue.append(then)
            row.append(number[then])
        moves.append(row)
    marks = [sum({ends[s] for s in now if s in ends}) for now in queue]

    # split classes of states until equal states agree on all their moves
    part = marks
    while True:
        keys = [(part[i], *(part[t] for t in moves[i])) for i in range(len(moves))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        fresh = [names[k] for k in keys]
        if len(names) == len(set(part)):
            break
        part = fresh
    part = fresh

    width = len(sample)
    whole = sorted(set(part), key=lambda p: (marks[part.index(p)] != 0, p))
    place = {p: i for i, p in enumerate(whole)}
    rows = {place[p]: moves[part.index(p)] for p in whole}
    accepts = tuple(marks[part.index(p)] for p in whole)
    table = tuple(place[part[t]] * width for i in range(len(whole)) for t in rows[i])
    dead = next((i * width for i in range(len(whole)) if not accepts[i] and all(table[i * width + c] == i * width for c in range(width))), -1)
    first = next((i for i, a in enumerate(accepts) if a), len(whole)) * width
    return Dfa(classes, table, accepts, width, place[part[0]] * width, first, dead)
