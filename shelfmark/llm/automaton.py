"""Rules as one deterministic automaton over bytes, and its run over many texts at once.

A rule is a regular expression of characters, classes, groups, ``|`` and the repeats ``? * + {m,n}``.
Its positions (one for each sign in it) with their followers are an automaton without empty steps.
The sets of positions that all rules can be in together become states (subset construction), equal
states are merged (minimisation), and bytes that no rule tells apart share a column of the table.

Texts are joined with a byte that no rule holds and cut into lanes of equal size. One step moves all
lanes by one byte, as one table look-up. A lane begins as if nothing stood before it; where the lane
before it ends in another state it runs again from there, as far as its states differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANES = 4096
#: Stands between texts; no UTF-8 text and no rule holds it.
GAP = 0xFF


@dataclass
class Node:
    """What an expression can begin and end with, whether it matches nothing, and its inner steps."""

    first: frozenset[int]
    last: frozenset[int]
    empty: bool
    steps: frozenset[tuple[int, int]]


class Expression:
    """Positions of one expression: ``bytes_of[i]`` is the set of bytes of position i."""

    def __init__(self, pattern: str, any_case: bool = False) -> None:
        self.text, self.at, self.any_case = pattern, 0, any_case
        self.bytes_of: list[frozenset[int]] = []
        self.root = self.choice()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} of {pattern!r}")
        if self.root.empty:
            raise ValueError(f"{pattern!r} matches the empty text")

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        sign = self.peek()
        if not sign:
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return sign

    def choice(self) -> Node:
        node = self.sequence()
        while self.peek() == "|":
            self.take()
            other = self.sequence()
            node = Node(node.first | other.first, node.last | other.last, node.empty or other.empty, node.steps | other.steps)
        return node

    def sequence(self) -> Node:
        node = Node(frozenset(), frozenset(), True, frozenset())
        while self.peek() not in ("", "|", ")"):
            node = self.joined(node, self.repeated())
        return node

    @staticmethod
    def joined(a: Node, b: Node) -> Node:
        return Node(
            a.first | b.first if a.empty else a.first, a.last | b.last if b.empty else b.last, a.empty and b.empty,
            a.steps | b.steps | {(x, y) for x in a.last for y in b.first},
        )

    def repeated(self) -> Node:
        start = self.at
        node = self.one()
        sign = self.peek()
        if sign == "?":
            least, most = 0, 1
        elif sign == "*":
            least, most = 0, None
        elif sign == "+":
            least, most = 1, None
        elif sign == "{":
            low, comma, high = self.text[self.at + 1 : self.text.index("}", self.at)].partition(",")
            least, most = int(low), (int(high) if high else None) if comma else int(low)
            self.at = self.text.index("}", self.at)
        else:
            return node
        self.at += 1
        end = self.at
        copies = [node]
        for _ in range(1, max(1, least if most is None else most)):  # each copy has positions of its own
            self.at = start
            copies.append(self.one())
        self.at = end
        if most is None:
            c = copies[-1]
            copies[-1] = Node(c.first, c.last, c.empty, c.steps | {(x, y) for x in c.last for y in c.first})
        out = Node(frozenset(), frozenset(), True, frozenset())
        for i, c in enumerate(copies):
            out = self.joined(out, c if i < least else Node(c.first, c.last, True, c.steps))
        return out

    def one(self) -> Node:
        sign = self.take()
        if sign == "(":
            node = self.choice()
            if self.take() != ")":
                raise ValueError(f"group left open in {self.text!r}")
            return node
        if sign == "[":
            return self.place(self.members())
        return self.place({self.code(sign)})

    def code(self, sign: str) -> int:
        if sign == "\\":
            sign = self.take()
            if sign == "x":
                return int(self.take() + self.take(), 16)
        if ord(sign) > 127:
            raise ValueError("rules are of ASCII signs")
        return ord(sign)

    def members(self) -> set[int]:
        out: set[int] = set()
        while (sign := self.take()) != "]":
            low = high = self.code(sign)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.code(self.take())
            out |= set(range(low, high + 1))
        return out

    def place(self, members: set[int]) -> Node:
        if self.any_case:
            members = {c for b in members for c in ({ord(chr(b).lower()), ord(chr(b).upper())} if b < 128 else {b})}
        self.bytes_of.append(frozenset(members))
        at = frozenset([len(self.bytes_of) - 1])
        return Node(at, at, False, frozenset())


@dataclass
class Automaton:
    """``table[state * columns + column]`` is the next state times ``columns``; state 0 is the start.

    ``accept[state]`` has a bit for each rule of which a match ends where the state is entered.
    """

    column: np.ndarray
    columns: int
    table: np.ndarray
    accept: np.ndarray
    dead: int

    def run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The joined texts and the state times ``columns`` after each byte."""
        buf = np.frombuffer(bytes([GAP]).join([*texts, b""]), np.uint8)
        lanes = max(1, min(LANES, len(buf) // 64))
        size = -(-len(buf) // lanes)
        full = np.full(lanes * size, self.column[GAP], self.column.dtype)
        full[: len(buf)] = self.column[buf]
        column = np.ascontiguousarray(full.reshape(lanes, size).T)
        states = np.empty((size, lanes), np.int32)
        at, index = np.zeros(lanes, np.int32), np.empty(lanes, np.int32)
        for t in range(size):
            np.add(at, column[t], out=index)
            at = np.take(self.table, index, out=states[t], mode="clip")
        self.mended(states, column)
        return buf, np.ascontiguousarray(states.T).reshape(-1)[: len(buf)]

    def mended(self, states: np.ndarray, column: np.ndarray) -> None:
        """Run lanes again from the state in which the lane before them ends."""
        size, lanes = states.shape
        began = np.zeros(lanes, np.int32)
        while True:
            entry = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
            lane = np.flatnonzero(entry != began)
            if not len(lane):
                return
            began[lane] = at = entry[lane]
            for t in range(size):
                at = self.table[at + column[t, lane]]
                differ = at != states[t, lane]
                if not differ.all():
                    lane, at = lane[differ], at[differ]
                    if not len(lane):
                        break
                states[t, lane] = at

    def walk(self, data: bytes, at: int, step: int, stop: int) -> list[int]:
        """Distances from ``at`` at which the automaton accepts, read in one direction up to ``stop``."""
        column, table, accept, state, found = self.lists()
        while at != stop:
            state = table[state + column[data[at]]]
            if state == self.dead:
                break
            at += step
            if accept[state]:
                found.append(at)
        return found

    def lists(self) -> tuple[list, list, list, int, list]:
        """The arrays as lists, which single steps read faster."""
        if not hasattr(self, "_lists"):
            wide = np.zeros(len(self.table) + 1, bool)
            wide[: len(self.accept) * self.columns : self.columns] = self.accept != 0
            self._lists = self.column.tolist(), self.table.tolist(), wide.tolist()
        return (*self._lists, 0, [])


def compiled(rules: list[Expression], anywhere: bool, backward: bool = False) -> Automaton:
    """The minimal automaton of all rules.

    ``anywhere`` lets a match begin at every byte; otherwise it begins with the first and the
    automaton falls into the state ``dead`` when none can follow. ``backward`` reads matches from
    their last byte.
    """
    bytes_of: list[frozenset[int]] = []
    follow: dict[int, set[int]] = {}
    begin: set[int] = set()
    ends: list[set[int]] = []
    for rule in rules:
        base = len(bytes_of)
        bytes_of += rule.bytes_of
        first, last = (rule.root.last, rule.root.first) if backward else (rule.root.first, rule.root.last)
        begin |= {base + i for i in first}
        ends.append({base + i for i in last})
        for a, b in rule.root.steps:
            a, b = (b, a) if backward else (a, b)
            follow.setdefault(base + a, set()).add(base + b)

    kinds: dict[frozenset[int], int] = {}
    column = np.zeros(256, np.uint8)
    for byte in range(256):
        column[byte] = kinds.setdefault(frozenset(i for i, s in enumerate(bytes_of) if byte in s), len(kinds))
    columns, allowed = len(kinds), list(kinds)

    start: frozenset[int] = frozenset([-1])
    number, order, rows = {start: 0}, [start], []
    for state in order:
        reach = set().union(*[follow.get(i, ()) for i in state])
        if anywhere or state is start:
            reach |= begin
        row = []
        for members in allowed:
            target = frozenset(reach & members) or (start if anywhere else frozenset())
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows, np.int32)
    accept = np.array([sum(1 << r for r, e in enumerate(ends) if s & e) for s in order], np.int32)

    same, n = accept, 0
    while True:  # states are the same as long as no step tells them apart
        seen: dict[bytes, int] = {}  # numbered by first appearance, so the start is 0
        steps = np.column_stack([same, same[table]])
        same = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in steps], np.int32)
        if len(seen) == n:
            break
        n = len(seen)
    first_of = np.zeros(n, np.int64)
    first_of[same[::-1]] = np.arange(len(same))[::-1]
    small = same[table[first_of]] * columns
    dead = int(same[number[frozenset()]]) * columns if frozenset() in number else -1
    return Automaton(column, columns, small.reshape(-1).astype(np.int32), accept[first_of].astype(np.int32), dead)
