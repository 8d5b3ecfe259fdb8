"""Rules as regular expressions, compiled to minimal deterministic automata over bytes.

Understood are ASCII literals, classes, groups, alternatives and greedy repeats; that is what
formats of secrets need.  A pattern is parsed by Python's own parser, turned into a
non-deterministic automaton, made deterministic by subset construction over classes of bytes that
no rule tells apart, and minimised by refining the partition of its states.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

_PARSER = re._parser  # the parser behind re.compile
_FEW = 4096  # bounds that a repeat may spell out


class _Nfa:
    """States are numbers; ``edges`` holds (bytes, target), ``free`` steps without a byte."""

    def __init__(self, reverse: bool):
        self.reverse = reverse
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.free) - 1

    def sequence(self, items, at: int, fold: bool) -> int:
        for op, value in reversed(list(items)) if self.reverse else items:
            at = self.item(str(op), value, at, fold)
        return at

    def item(self, op: str, value, at: int, fold: bool) -> int:
        if op in ("LITERAL", "IN"):
            end = self.state()
            self.edges[at].append((_bytes(op, value, fold), end))
            return end
        if op == "SUBPATTERN":
            _, on, off, items = value
            return self.sequence(items, at, (fold or bool(on & re.I)) and not off & re.I)
        if op == "BRANCH":
            end = self.state()
            for items in value[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self.sequence(items, start, fold)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, items = value
            if low > _FEW or (high != _PARSER.MAXREPEAT and high > _FEW):
                raise ValueError("the repeat is too long to spell out")
            for _ in range(low):
                at = self.sequence(items, at, fold)
            end = self.state()
            self.free[at].append(end)
            if high == _PARSER.MAXREPEAT:
                start = self.state()
                self.free[end].append(start)
                self.free[self.sequence(items, start, fold)].append(end)
            else:
                for _ in range(high - low):
                    at = self.sequence(items, at, fold)
                    self.free[at].append(end)
            return end
        raise ValueError(f"not understood in a rule: {op.lower()}")

    def closure(self, states: set[int]) -> frozenset[int]:
        open_, seen = list(states), set(states)
        while open_:
            for target in self.free[open_.pop()]:
                if target not in seen:
                    seen.add(target)
                    open_.append(target)
        return frozenset(seen)


def _bytes(op: str, value, fold: bool) -> frozenset[int]:
    if op == "LITERAL":
        found = {value}
    else:
        found, negate = set(), False
        for kind, x in value:
            if str(kind) == "NEGATE":
                negate = True
            elif str(kind) == "LITERAL":
                found.add(x)
            elif str(kind) == "RANGE":
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"not understood in a class: {kind}")
        if negate:
            raise ValueError("a rule names the characters it takes")
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {ord(f(chr(b))) for b in found for f in (str.lower, str.upper)}
    return frozenset(found)


@dataclass
class Automaton:
    """``table[state + class]`` is the next state; states are multiples of the class count.

    ``kinds`` maps a class to each byte; states from ``accepting`` on accept, ``accepts`` tells
    which patterns; state ``dead`` accepts nothing any more (-1: there is none).
    """

    kinds: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    accepts: dict[int, tuple[int, ...]] = field(default_factory=dict)
    dead: int = -1

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at a place; -1 if none does."""
        table, kinds, accepting, dead = self.table, self.kinds, self.accepting, self.dead
        state, end = self.start, at if self.start >= accepting else -1
        for place in range(at, len(data)):
            state = table[state + kinds[data[place]]]
            if state >= accepting:
                end = place + 1
            elif state == dead:
                break
        return end


def compiled(patterns: list[str], reverse: bool = False, anywhere: bool = False) -> Automaton:
    """The minimal automaton of all patterns together.

    With ``reverse`` it reads texts from the end; with ``anywhere`` a match may start at any byte,
    so that it accepts wherever a match ends (reversed: wherever one starts).
    """
    nfa = _Nfa(reverse)
    root = nfa.state()
    final: dict[int, int] = {}
    for number, pattern in enumerate(patterns):
        start = nfa.state()
        nfa.free[root].append(start)
        final[nfa.sequence(_PARSER.parse(pattern), start, False)] = number
    kinds, width, samples = _byte_classes(nfa)
    first = nfa.closure({root})
    numbers, order, rows = {first: 0}, [first], []
    for subset in order:  # grows while it is read
        row = []
        for byte in samples:
            reached = {t for s in subset for taken, t in nfa.edges[s] if byte in taken}
            target = nfa.closure(reached | ({root} if anywhere else set()))
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        rows.append(row)
    accepts = [tuple(sorted(final[s] for s in subset if s in final)) for subset in order]
    return _minimal(np.array(rows), accepts, kinds, width)


def _byte_classes(nfa: _Nfa) -> tuple[bytes, int, list[int]]:
    sets = sorted({taken for edges in nfa.edges for taken, _ in edges}, key=sorted)
    signatures = [tuple(byte in s for s in sets) for byte in range(256)]
    numbers = {signature: k for k, signature in enumerate(dict.fromkeys(signatures))}
    samples = [signatures.index(signature) for signature in numbers]
    return bytes(numbers[s] for s in signatures), len(numbers), samples


def _minimal(rows: np.ndarray, accepts: list[tuple], kinds: bytes, width: int) -> Automaton:
    names = {a: k for k, a in enumerate(sorted(set(accepts)))}
    block = np.array([names[a] for a in accepts])
    while True:
        seen = np.column_stack([block, block[rows]])
        _, refined = np.unique(seen, axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    _, members = np.unique(block, return_index=True)  # one state of each block
    ranked = sorted(range(len(members)), key=lambda b: (bool(accepts[members[b]]), b))
    place = {b: k * width for k, b in enumerate(ranked)}
    table = [place[int(t)] for b in ranked for t in block[rows[members[b]]]]
    found = {place[b]: accepts[members[b]] for b in ranked if accepts[members[b]]}
    dead = next(
        (
            place[b]
            for b in ranked
            if not accepts[members[b]] and set(block[rows[members[b]]].tolist()) == {b}
        ),
        -1,
    )
    accepting = min(found, default=len(table))
    return Automaton(kinds, width, table, place[int(block[0])], accepting, found, dead)
