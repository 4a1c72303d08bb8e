"""Byte regexes to one minimal deterministic automaton: Thompson construction, subset construction, partition refinement.

Syntax: literals, `\\xNN` and escaped punctuation, `.`-free classes with ranges and `^`, groups, `|`, `? * + {m} {m,} {m,n}`.
A leading `(?i)` takes ASCII letters in either case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = (1 << 256) - 1


class _Parser:
    """Regex text to a tree of ("set", mask), ("cat", ...), ("alt", ...), ("rep", tree, least, most)."""

    def __init__(self, text: str):
        self.fold = text.startswith("(?i)")
        self.s = text.removeprefix("(?i)")
        self.i = 0

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", *branches)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated())
        return ("cat", *items)

    def repeated(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(low), (int(high) if high else None) if comma else int(low))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def folded(self, mask: int) -> int:
        if self.fold:
            for b in range(65, 91):
                both = 1 << b | 1 << b + 32
                if mask & both:
                    mask |= both
        return mask

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            if self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError("unclosed group")
            return tree
        if c == "[":
            self.take()
            negated = self.peek() == "^"
            if negated:
                self.take()
            mask = 0
            while self.peek() != "]" or not mask:
                low = high = self.byte()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.take()
                    high = self.byte()
                for b in range(low, high + 1):
                    mask |= 1 << b
            self.take()
            mask = self.folded(mask)
            return ("set", ALL ^ mask if negated else mask)
        return ("set", self.folded(1 << self.byte()))


def reverse(tree):
    if tree[0] == "cat":
        return ("cat", *(reverse(x) for x in reversed(tree[1:])))
    if tree[0] == "alt":
        return ("alt", *(reverse(x) for x in tree[1:]))
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.move: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def add(self, tree, at: int) -> int:
        """Appends tree behind state `at`; returns the state where it ends."""
        if tree[0] == "set":
            end = self.state()
            here = self.state()
            self.eps[at].append(here)
            self.move[here] = (tree[1], end)
            return end
        if tree[0] == "cat":
            for x in tree[1:]:
                at = self.add(x, at)
            return at
        if tree[0] == "alt":
            end = self.state()
            for x in tree[1:]:
                here = self.state()
                self.eps[at].append(here)
                self.eps[self.add(x, here)].append(end)
            return end
        _, x, least, most = tree
        for _ in range(least):
            at = self.add(x, at)
        if most is None:
            loop = self.state()
            self.eps[at].append(loop)
            self.eps[self.add(x, loop)].append(loop)
            return loop
        end = self.state()
        self.eps[at].append(end)
        for _ in range(most - least):
            at = self.add(x, at)
            self.eps[at].append(end)
        return end


@dataclass
class Automaton:
    """classes[byte] -> class, step[state, class] -> state, accept[state] -> bit mask of rules. Start is `start`; `dead` or -1."""

    classes: bytes
    step: np.ndarray
    accept: np.ndarray
    start: int
    dead: int


def compile_rules(patterns: list[str], anchored: bool = False, backwards: bool = False) -> Automaton:
    """anchored: matches begin at the first byte only; else at every byte. backwards: for reading from a match's end."""
    nfa, finals = _Nfa(), {}
    start = nfa.state()
    for k, p in enumerate(patterns):
        tree = _Parser(p).parse()
        here = nfa.state()
        nfa.eps[start].append(here)
        finals[nfa.add(reverse(tree) if backwards else tree, here)] = 1 << k
    masks = {m[0] for m in nfa.move if m}
    # Bytes that every set treats alike share a class.
    signs: dict[tuple, int] = {}
    ordered = sorted(masks)
    classes = bytes(signs.setdefault(tuple(m >> b & 1 for m in ordered), len(signs)) for b in range(256))
    n_classes = len(signs)
    sample = [classes.index(c) for c in range(n_classes)]

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.move[s] or s in finals)

    first = closure([start])
    ids, todo, rows, accept = {first: 0}, [first], [], []
    reach: dict[int, frozenset] = {}
    while todo:
        here = todo.pop(0)
        accept.append(sum({finals[s] for s in here if s in finals}))
        moves = [nfa.move[s] for s in here if nfa.move[s]]
        row = []
        for b in sample:
            out: set = set() if anchored else set(first)
            for mask, to in moves:
                if mask >> b & 1:
                    if to not in reach:
                        reach[to] = closure([to])
                    out |= reach[to]
            out = frozenset(out)
            if out not in ids:
                ids[out] = len(ids)
                todo.append(out)
            row.append(ids[out])
        rows.append(row)
    step, accept = np.array(rows), np.array(accept)
    # Minimisation: split blocks by accepted rules, then by the blocks that each class leads to, until nothing splits.
    block = np.unique(accept, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, pick = np.unique(block, return_index=True)
    step, accept = block[step[pick]].astype(np.int32), accept[pick]
    dead = [s for s in range(len(step)) if not accept[s] and (step[s] == s).all()]
    return Automaton(classes, step, accept, int(block[0]), dead[0] if dead and dead[0] != block[0] else -1)
