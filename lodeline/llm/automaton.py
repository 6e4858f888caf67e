"""One deterministic automaton for many patterns, run over overlapping chunks of text in lock step."""

from __future__ import annotations

import re

import numpy as np

CHUNK = 1024
_CLASSES = {"s": "\t\n\v\f\r \x85\u00a0\u3000", "d": "0123456789", "n": "\n", "t": "\t"}
_REPEAT = re.compile(r"\{(\d+)(,?)(\d*)\}")


class Automaton:
    """Patterns, in letter case of no account, found anywhere in a text; ``run`` gives where each ends.

    Patterns are regular expressions of literals, sets, groups, alternatives and repetitions. All chunks of
    all texts begin at the start state and read ``overlap`` characters of the chunk before; where that
    chunk ends in another state than the overlap led to, as in a match longer than it, the chunk is read
    again from there. So a match of any length is found.
    """

    def __init__(self, patterns: list[str], overlap: int = 160):
        self.overlap = overlap
        self.edges: list[list[tuple[frozenset | None, bool, int]]] = []  # by state: (characters, negated, next); None: without reading
        accepts: dict[int, int] = {}
        start = self._state()
        for no, pattern in enumerate(patterns):
            build, read = self._alternatives(pattern.lower(), 0)
            if read != len(pattern):
                raise ValueError(f"not a plain pattern: {pattern}")
            end = build(start)
            accepts[end] = accepts.get(end, 0) | 1 << no
        alphabet = sorted({c for edges in self.edges for chars, _, _ in edges for c in chars or ()})
        self.char_class = np.zeros(0x10000, dtype=np.uint8)
        self.n_classes = len(alphabet) + 2  # 0: any other character; the last: the border between texts
        for i, c in enumerate(alphabet):
            self.char_class[c] = i + 1
        for c in range(65, 91):
            self.char_class[c] = self.char_class[c + 32]
        for c in range(0xC0, 0xDF):
            self.char_class[c] = self.char_class[c + 32]
        self.border = self.n_classes - 1
        self.table, self.accept = self._determine(start, accepts, alphabet)

    def _state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _edge(self, a: int, b: int, chars=None, negated=False) -> None:
        self.edges[a].append((None if chars is None else frozenset(chars), negated, b))

    # A pattern is read by descent: alternatives of sequences of atoms, each with how often it stands. States are made
    # anew for every repetition, so an atom is a function that builds itself between two states.

    def _alternatives(self, p: str, i: int):
        sequence, i = self._sequence(p, i)
        options = [sequence]
        while i < len(p) and p[i] == "|":
            sequence, i = self._sequence(p, i + 1)
            options.append(sequence)

        def build(at: int) -> int:
            if len(options) == 1:
                return options[0](at)
            after = self._state()
            for option in options:
                first = self._state()
                self._edge(at, first)
                self._edge(option(first), after)
            return after

        return build, i

    def _sequence(self, p: str, i: int):
        parts = []
        while i < len(p) and p[i] not in "|)":
            atom, i = self._atom(p, i)
            least, most = 1, 1
            if i < len(p) and p[i] in "*+?":
                least, most, i = {"*": (0, None), "+": (1, None), "?": (0, 1)}[p[i]] + (i + 1,)
            elif m := _REPEAT.match(p, i):
                least, i = int(m[1]), m.end()
                most = least if not m[2] else int(m[3]) if m[3] else None
            parts.append((atom, least, most))

        def build(at: int) -> int:
            for atom, least, most in parts:
                at = self._repeated(atom, least, most, at)
            return at

        return build, i

    def _repeated(self, atom, least: int, most: int | None, at: int) -> int:
        for _ in range(least):
            at = atom(at)
        if most == least:
            return at
        after = self._state()
        self._edge(at, after)
        if most is None:
            self._edge(at, loop := self._state())
            self._edge(atom(loop), loop)
            self._edge(loop, after)
        for _ in range((most or least) - least):
            at = atom(at)
            self._edge(at, after)
        return after

    def _atom(self, p: str, i: int):
        if p[i] == "(":
            build, i = self._alternatives(p, i + 1)
            return build, i + 1
        negated = False
        if p[i] == "[":
            i += 1
            if negated := p[i] == "^":
                i += 1
            chars: set[int] = set()
            while p[i] != "]":
                one, i = self._characters(p, i)
                if len(one) == 1 and p[i] == "-" and p[i + 1] != "]":
                    end, i = self._characters(p, i + 1)
                    one = set(range(min(one), max(end) + 1))
                chars |= one
            i += 1
        else:
            chars, i = self._characters(p, i)

        def build(at: int) -> int:
            after = self._state()
            self._edge(at, after, chars, negated)
            return after

        return build, i

    @staticmethod
    def _characters(p: str, i: int) -> tuple[set[int], int]:
        if p[i] == "\\":
            return set(map(ord, _CLASSES.get(p[i + 1], p[i + 1]))), i + 2
        if p[i] in "*+?{":
            raise ValueError(f"not a plain pattern: {p}")
        return {ord(p[i])}, i + 1

    def _closed(self, states) -> frozenset:
        seen, stack = set(states), list(states)
        while stack:
            for chars, _, b in self.edges[stack.pop()]:
                if chars is None and b not in seen:
                    seen.add(b)
                    stack.append(b)
        return frozenset(seen)

    def _determine(self, start: int, accepts: dict[int, int], alphabet: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Subset construction; the start stays open in every state, as a match may begin anywhere."""
        closed = [self._closed({s}) for s in range(len(self.edges))]
        reading = [[e for e in edges if e[0] is not None] for edges in self.edges]
        number, todo, rows, marks = {closed[start]: 0}, [closed[start]], [], []
        merged: dict[frozenset, int] = {}
        for here in todo:
            goes: dict[int | None, set[int]] = {}
            always: set[int] = set()
            but: list[tuple[frozenset, int]] = []
            for s in here:
                for chars, negated, b in reading[s]:
                    if negated:
                        always.add(b)
                        but.append((chars, b))
                    else:
                        for c in chars:
                            goes.setdefault(c, set()).add(b)
            row = []
            for c in [None, *alphabet]:
                told = goes.get(c, set()) | (always - {b for chars, b in but if c in chars and not any(x == b and c not in y for y, x in but)})
                key = frozenset(told)
                if key not in merged:
                    there = frozenset().union(closed[start], *(closed[t] for t in key))
                    if there not in number:
                        number[there] = len(number)
                        todo.append(there)
                    merged[key] = number[there]
                row.append(merged[key])
            rows.append([*row, 0])
            marks.append(sum(accepts.get(s, 0) for s in here))
        return np.array(rows, dtype=np.int32).ravel() * self.n_classes, np.array(marks, dtype=np.int64)

    def run(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, position after the match, bits of the patterns) of every end of a match, in order."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = np.where(points < 0x10000, self.char_class[np.minimum(points, 0xFFFF)], 0).astype(np.int32)
        classes[starts[1:] - 1] = self.border
        step = CHUNK - self.overlap
        n = max(1, -(-len(classes) // step))
        padded = np.full((n - 1) * step + CHUNK, self.border, dtype=np.int32)
        padded[: len(classes)] = classes[: len(padded)]
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step].T)
        state, marked = np.zeros(n, dtype=np.int32), self.accept != 0
        chunks, ends, led = [], [], state
        for j in range(CHUNK):
            state = self.table[state + columns[j]]
            hit = np.flatnonzero(marked[state // self.n_classes])
            if len(hit):
                chunks.append(hit * step + j + 1)
                ends.append(self.accept[state[hit] // self.n_classes])
            if j == self.overlap - 1:
                led = state
        for first in np.flatnonzero(state[:-1] != led[1:]) + 1:
            i = int(first)
            while i < n and state[i - 1] != led[i]:
                here, at, more = int(state[i - 1]), [], []
                for j in range(self.overlap, CHUNK):
                    here = int(self.table[here + columns[j, i]])
                    if marked[here // self.n_classes]:
                        at.append(i * step + j + 1)
                        more.append(self.accept[here // self.n_classes])
                led[i] = state[i - 1]
                state[i] = here
                chunks.append(np.array(at, dtype=np.int64))
                ends.append(np.array(more, dtype=np.int64))
                i += 1
        if not chunks:
            return []
        # Overlaps see the same end twice.
        at, bits = np.concatenate(chunks), np.concatenate(ends)
        found, where = np.unique(at, return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.bitwise_or.at(total, where, bits)
        text = np.searchsorted(starts, found - 1, side="right") - 1
        return list(zip(text.tolist(), (found - starts[text]).tolist(), total.tolist(), strict=True))
