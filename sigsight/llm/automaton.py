"""Rule expressions compiled into one deterministic byte automaton.

``re``'s own parser reads the expressions (literals, classes, groups, branches,
repeats, a case-insensitive group); they become a nondeterministic automaton,
subset construction makes it deterministic over classes of equivalent bytes, and
partition refinement minimises it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_parser, _codes = re._parser, re._constants


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[np.ndarray, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, items, start: int, back: bool, fold: bool) -> int:
        """Append the parsed sequence after ``start``; ``back`` builds it in reverse."""
        for op, arg in reversed(list(items)) if back else items:
            start = self._item(op, arg, start, back, fold)
        return start

    def _item(self, op, arg, start: int, back: bool, fold: bool) -> int:
        end = self.state()
        if op is _codes.SUBPATTERN:
            inner = self.add(arg[3], start, back, fold or bool(arg[1] & re.IGNORECASE))
            self.empty[inner].append(end)
        elif op is _codes.BRANCH:
            for one in arg[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(one, first, back, fold)].append(end)
        elif op is _codes.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start, back, fold)
            self.empty[start].append(end)
            if most is _codes.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(inner, loop, back, fold)] += [loop, end]
            else:
                for _ in range(most - least):
                    start = self.add(inner, start, back, fold)
                    self.empty[start].append(end)
        else:
            self.moves[start].append((_byte_set(op, arg, fold), end))
        return end


def _byte_set(op, arg, fold: bool) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    if op is _codes.LITERAL:
        found[arg] = True
    elif op is _codes.NOT_LITERAL:
        found[:] = True
        found[arg] = False
    elif op is _codes.ANY:
        found[:] = True
        found[10] = False
    elif op is _codes.IN:
        for kind, x in arg:
            if kind is _codes.RANGE:
                found[x[0] : x[1] + 1] = True
            elif kind is _codes.LITERAL:
                found[x] = True
            elif kind is not _codes.NEGATE:
                raise ValueError(f"unsupported class member {kind}")
        if arg[0][0] is _codes.NEGATE:
            found = ~found
    else:
        raise ValueError(f"unsupported expression {op}")
    if fold:
        letters = found[65:91] | found[97:123]
        found[65:91] = letters
        found[97:123] = letters
    return found


@dataclass
class Automaton:
    """``step[state, group[byte]]``; ``accept[state]`` has bit r for rule r; state 0 is the start."""

    step: np.ndarray
    group: np.ndarray
    accept: np.ndarray

    @property
    def dead(self) -> np.ndarray:
        """States that no byte leaves and that accept nothing."""
        return (self.step == np.arange(len(self.step))[:, None]).all(axis=1) & (self.accept == 0)

    @property
    def resets(self) -> np.ndarray:
        """Bytes that lead to the start from everywhere: a text may be cut after them."""
        return (self.step == 0).all(axis=0)[self.group]


def compile_rules(patterns: list[bytes], anywhere: bool = True, back: bool = False) -> Automaton:
    """One minimal automaton for all patterns.

    ``anywhere``: a match may start at any byte; ``back``: reads the text backwards.
    """
    nfa, root, final = _Nfa(), 0, {}
    nfa.state()
    for r, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.empty[root].append(first)
        final[nfa.add(_parser.parse(pattern), first, back, False)] = 1 << r
    table = np.array([s for moves in nfa.moves for s, _ in moves])
    group = np.unique(table.T, axis=0, return_inverse=True)[1].reshape(-1)
    sample = np.array([int(np.flatnonzero(group == g)[0]) for g in range(group.max() + 1)])

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.moves[x] or x in final)

    start = closure({root})
    number, rows, todo = {start: 0}, [], [start]
    for subset in todo:
        row = []
        for byte in sample:
            after = {to for x in subset for s, to in nfa.moves[x] if s[byte]}
            if anywhere:
                after.add(root)
            target = closure(after)
            if target not in number:
                number[target] = len(todo)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    accept = np.array([sum({final[x] for x in s if x in final}) for s in todo], dtype=np.int64)
    return _minimal(np.array(rows), group, accept)


def _minimal(step: np.ndarray, group: np.ndarray, accept: np.ndarray) -> Automaton:
    """Refine the partition by accepted rules until every block's moves agree."""
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    first = np.unique(block, return_index=True)[1]
    order[np.argsort(np.where(first == first[block[0]], -1, first))] = np.arange(len(first))
    keep = np.empty(len(first), dtype=np.int64)
    keep[order] = first
    return Automaton(order[block[step[keep]]].astype(np.int32), group.astype(np.int32), accept[keep])


def scan(machine: Automaton, blob: np.ndarray, piece: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which some rule accepts, and the rules' bits there.

    Every byte is read once.  The text is cut after bytes that reset the
    automaton, about every ``piece`` bytes, and the pieces advance in step.
    """
    none = np.empty(0, dtype=np.int64)
    if not len(blob):
        return none, none
    codes = machine.group[blob]
    cuts = np.flatnonzero(machine.resets[blob]) + 1
    at = np.searchsorted(cuts, np.arange(piece, len(blob), piece))
    starts = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]]]))
    starts = starts[starts < len(blob)]
    sizes = np.diff(np.append(starts, len(blob)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    width = machine.step.shape[1]
    flat = (machine.step * width).reshape(-1)
    heard = np.repeat(machine.accept != 0, width)[::width]
    state = np.zeros(len(starts), dtype=np.int64)
    where, live = [], len(starts)
    which = []
    shrink = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for t in range(sizes[0]):
        live = shrink[t]
        state = flat[state[:live] + codes[starts[:live] + t]]
        hit = heard[state // width]
        if hit.any():
            found = np.flatnonzero(hit)
            where.append(starts[found] + t)
            which.append(machine.accept[state[found] // width])
    if not where:
        return none, none
    where, which = np.concatenate(where), np.concatenate(which)
    order = np.argsort(where)
    return where[order], which[order]
