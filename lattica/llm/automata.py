"""Byte automata: patterns to NFAs, subset construction, minimisation, transition arrays.

The pattern language is what the rules need: literals, ``\\x20`` and escaped characters, classes with
ranges and negation, groups, ``(?i:...)`` for ASCII letters in either case, ``|``, ``? * +`` and
``{m} {m,} {m,n}``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

ALL = frozenset(range(256))


class _Nfa:
    """States with epsilon moves and moves on byte sets; ``accepts`` gives a final state's rules as bits."""

    def __init__(self) -> None:
        self.epsilon: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.epsilon.append([])
        self.moves.append([])
        return len(self.moves) - 1


class _Parser:
    """Recursive descent to a tree of (kind, ...) tuples."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self):
        tree = self.either(False)
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def either(self, fold: bool):
        branches = [self.row(fold)]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.row(fold))
        return branches[0] if len(branches) == 1 else ("or", branches)

    def row(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.item(fold)))
        return ("row", parts)

    def item(self, fold: bool):
        c = self.peek()
        if c == "(":
            self.at += 1
            for opening, folds in (("?i:", True), ("?:", fold)):
                if self.text.startswith(opening, self.at):
                    self.at += len(opening)
                    fold = folds
                    break
            tree = self.either(fold)
            self.at += 1
            return tree
        if c == "[":
            return ("set", self.cased(self.char_class(), fold))
        return ("set", self.cased(frozenset([self.char()]), fold))

    @staticmethod
    def cased(chars: frozenset[int], fold: bool) -> frozenset[int]:
        if not fold:
            return chars
        letters = {c for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return chars | {c ^ 32 for c in letters}

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            c = {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def char_class(self) -> frozenset[int]:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        out: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                out |= set(range(low, self.char() + 1))
            else:
                out.add(low)
        self.at += 1
        return ALL - out if negated else frozenset(out)

    def repeated(self, tree):
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.text.index("}", self.at)
                a, comma, b = self.text[self.at : end].partition(",")
                low, high = int(a), int(a) if not comma else int(b) if b else None
                self.at = end + 1
            tree = ("times", tree, low, high)
        return tree


def _build(nfa: _Nfa, tree, start: int) -> int:
    """Add ``tree`` after ``start``; returns its last state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "row":
        for part in tree[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for branch in tree[1]:
            first = nfa.state()
            nfa.epsilon[start].append(first)
            nfa.epsilon[_build(nfa, branch, first)].append(end)
        return end
    _, inner, low, high = tree
    for _ in range(low):
        start = _build(nfa, inner, start)
    if high is None:
        loop = nfa.state()
        nfa.epsilon[start].append(loop)
        nfa.epsilon[_build(nfa, inner, loop)].append(loop)
        return loop
    end = nfa.state()
    nfa.epsilon[start].append(end)
    for _ in range(high - low):
        start = _build(nfa, inner, start)
        nfa.epsilon[start].append(end)
    return end


def _reversed(tree):
    if tree[0] == "row":
        return ("row", [_reversed(p) for p in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_reversed(p) for p in tree[1]])
    if tree[0] == "times":
        return ("times", _reversed(tree[1]), *tree[2:])
    return tree


@dataclass(frozen=True)
class Dfa:
    """``table[state << 8 | byte]`` is the next state, shifted by 8; accepting states come last.

    ``first`` is the shifted number of the first accepting state, ``rules`` maps shifted accepting
    states to bit masks of rules, ``dead`` is the shifted state from which nothing is accepted, or -1.
    """

    table: list[int]
    start: int
    first: int
    rules: dict[int, int]
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) >> 8


def compile_rules(patterns: Sequence[str], anywhere: bool = False, backward: bool = False) -> Dfa:
    """The minimal automaton of all patterns at once. ``anywhere`` lets matches begin at every byte."""
    nfa = _Nfa()
    root = nfa.state()
    for i, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        first = nfa.state()
        nfa.epsilon[root].append(first)
        nfa.accepts[_build(nfa, _reversed(tree) if backward else tree, first)] = 1 << i
    if anywhere:
        nfa.moves[root].append((ALL, root))
    return _minimal(*_subsets(nfa, root))


def _byte_classes(sets: Iterable[frozenset[int]]) -> list[int]:
    """A class for each byte: bytes that no set tells apart share one."""
    marks = [[] for _ in range(256)]
    for i, s in enumerate(set(sets)):
        for b in s:
            marks[b].append(i)
    numbers: dict[tuple, int] = {}
    return [numbers.setdefault(tuple(m), len(numbers)) for m in marks]


def _subsets(nfa: _Nfa, root: int) -> tuple[list[list[int]], list[int], list[int]]:
    classes = _byte_classes(s for moves in nfa.moves for s, _ in moves)
    sample = [classes.index(c) for c in range(max(classes) + 1)]
    by_class = [[[to for s, to in moves if b in s] for b in sample] for moves in nfa.moves]

    def closed(states: Iterable[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in nfa.epsilon[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    numbers = {closed([root]): 0}
    todo, rows, accepts = deque(numbers), [], []
    while todo:
        subset = todo.popleft()
        mask = 0
        for s in subset:
            mask |= nfa.accepts.get(s, 0)
        accepts.append(mask)
        row = []
        for c in range(len(sample)):
            target = closed({t for s in subset for t in by_class[s][c]})
            if target not in numbers:
                numbers[target] = len(numbers)
                todo.append(target)
            row.append(numbers[target])
        rows.append(row)
    return rows, accepts, classes


def _minimal(rows: list[list[int]], accepts: list[int], classes: list[int]) -> Dfa:
    """Partition refinement until no block is split; blocks become states, accepting ones last."""
    block = _renumbered(accepts)
    count = max(block) + 1
    while True:
        block = _renumbered([(block[i], *[block[t] for t in row]) for i, row in enumerate(rows)])
        if max(block) + 1 == count:
            break
        count = max(block) + 1
    member = {b: i for i, b in reversed(list(enumerate(block)))}
    order = sorted(member, key=lambda b: bool(accepts[member[b]]))
    place = {b: i for i, b in enumerate(order)}
    table, rules, dead = [], {}, -1
    for i, b in enumerate(order):
        row = [place[block[t]] << 8 for t in rows[member[b]]]
        table += [row[c] for c in classes]
        if accepts[member[b]]:
            rules[i << 8] = accepts[member[b]]
        elif all(t == i << 8 for t in row):
            dead = i << 8
    return Dfa(table, place[block[0]] << 8, min(rules, default=len(order) << 8), rules, dead)


def _renumbered(keys: list) -> list[int]:
    numbers: dict = {}
    return [numbers.setdefault(k, len(numbers)) for k in keys]
