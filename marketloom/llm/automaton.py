"""Regular expressions to one deterministic automaton: NFA, subset construction, minimisation, transition arrays."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

import numpy as np

LANE = 2048


class _Nfa:
    """States with byte-set edges and empty edges, built from the standard library's parse of a pattern."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        for op, arg in tree:
            at = self._step(op, arg, at)
        return at

    def _step(self, op, arg, at: int) -> int:
        if op is sre.SUBPATTERN:
            return self.add(arg[3], at)
        if op is sre.BRANCH:
            end = self.state()
            for branch in arg[1]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(branch, start)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self.add(body, at)
            if high is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[at] += [loop, end]
                self.empty[self.add(body, loop)] += [loop, end]
                return end
            end = self.state()
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self.add(body, at)
                self.empty[at].append(end)
            return end
        end = self.state()
        self.edges[at].append((self._bytes(op, arg), end))
        return end

    @staticmethod
    def _bytes(op, arg) -> frozenset[int]:
        if op is sre.LITERAL:
            return frozenset([arg])
        if op is sre.NOT_LITERAL:
            return frozenset(range(256)) - {arg}
        if op is sre.ANY:
            return frozenset(range(256)) - {10}
        if op is not sre.IN:
            raise ValueError(f"not supported in a scan rule: {op}")
        out, negate = set(), False
        for kind, x in arg:
            if kind is sre.NEGATE:
                negate = True
            elif kind is sre.LITERAL:
                out.add(x)
            elif kind is sre.RANGE:
                out.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"not supported in a scan rule: {kind}")
        return frozenset(range(256)) - out if negate else frozenset(out)

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    """step[state * classes + column[byte]] is the next state; accepts[state] has a bit per rule; state 0 starts; dead: -1 or a state."""

    column: np.ndarray
    classes: int
    step: np.ndarray
    accepts: np.ndarray
    dead: int

    def states_after(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """State after every byte; each row of the text starts anew.

        All stretches of at most LANE bytes advance together from the start state; a stretch that continues a row is then corrected
        from the state before it, byte by byte, only as far as the states differ.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.uint16)
        row_starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
        lengths = np.diff(np.append(row_starts, n))
        parts = -(-lengths // LANE)
        begin = np.repeat(row_starts, parts) + LANE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(np.append(begin[1:], n), begin + LANE)
        col, out = self.column[data], np.empty(n, np.uint16)
        order = np.argsort(begin - end, kind="stable")  # longest first
        b, size = begin[order], (end - begin)[order]
        state = np.zeros(len(b), np.int64)
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # lanes longer than k
        for k in range(size[0]):
            m = live[k]
            at = b[:m] + k
            state[:m] = self.step[state[:m] * self.classes + col[at]]
            out[at] = state[:m]
        lanes = np.flatnonzero(~np.isin(begin, row_starts))
        while len(lanes):
            at, state, until = begin[lanes].copy(), out[begin[lanes] - 1].astype(np.int64), end[lanes]
            own, changed_end = lanes, []
            while len(at):
                state = self.step[state * self.classes + col[at]]
                differs = out[at] != state
                out[at[differs]] = state[differs]
                last = at + 1 == until
                changed_end.append(own[differs & last])
                go = differs & ~last
                at, state, until, own = at[go] + 1, state[go], until[go], own[go]
            changed = np.concatenate(changed_end)
            lanes = changed[changed + 1 < len(begin)] + 1
            lanes = lanes[~np.isin(begin[lanes], row_starts)]
        return out

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts here, or -1."""
        state, best = 0, -1
        for k in range(at, len(data)):
            state = int(self.step[state * self.classes + self.column[data[k]]])
            if state == self.dead:
                break
            if self.accepts[state]:
                best = k + 1
        return best

    def first_bytes(self) -> np.ndarray:
        return self.step[self.column] != self.dead


def compile_rules(patterns: list[str], search: bool) -> Dfa:
    """One automaton for all patterns; search: matches may start at any byte, else at the first."""
    nfa = _Nfa()
    start = nfa.state()
    final: dict[int, int] = {}
    for rule, p in enumerate(patterns):
        first = nfa.state()
        nfa.empty[start].append(first)
        final[nfa.add(sre_parser.parse(p), first)] = 1 << rule
    sets = {s for e in nfa.edges for s, _ in e}
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    kinds = {k: i for i, k in enumerate(dict.fromkeys(signature.values()))}
    column = np.array([kinds[signature[b]] for b in range(256)], np.int64)
    sample = [int(np.flatnonzero(column == c)[0]) for c in range(len(kinds))]
    root = nfa.closure([start])
    names, todo, rows = {root: 0}, [root], []
    while len(rows) < len(todo):
        cur, row = todo[len(rows)], []
        for b in sample:
            to = {x for s in cur for bytes_, x in nfa.edges[s] if b in bytes_}
            nxt = nfa.closure(to | ({start} if search else set()))
            if nxt not in names:
                names[nxt] = len(todo)
                todo.append(nxt)
                if len(todo) > 65_535:
                    raise ValueError("too many states: shorten counted repeats")
            row.append(names[nxt])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum({final.get(s, 0) for s in t}) for t in todo])
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:  # merge states that no continuation tells apart
        new = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    rename = np.full(block.max() + 1, -1)
    order = np.unique(block, return_index=True)[1]
    order = order[np.argsort(order)]
    rename[block[order]] = np.arange(len(order))
    small = rename[block[step[order]]]
    acc = accepts[order]
    dead = [s for s in range(len(order)) if not acc[s] and (small[s] == s).all()]
    return Dfa(column, len(kinds), small.reshape(-1).astype(np.int64), acc, dead[0] if dead else -1)
