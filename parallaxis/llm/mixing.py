"""Logistic context mixing of binary decisions, as array work.

A symbol is spelt by the decisions of a Huffman code. Each context has a table of counts
in hashed cells, one cell for a context's value and a node of the code. A decision's
inputs are the cells' log odds; a mixer chosen by the depth of the decision and by how
well the two longest contexts are known weighs them in the logistic domain, and an
adaptive map by depth refines the result. Mixers and maps learn online, batch by batch:
a batch is predicted with what the batches before it taught, then they move.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Classes of depth of a decision that have mixers and maps of their own: first, second and third, to sixth, further.
DEPTHS = 4
KNOWN_CLASSES = 3
GATES = KNOWN_CLASSES * KNOWN_CLASSES
MIXERS = DEPTHS * GATES
MAP_BUCKETS = 33
#: Curvature that the first weights are worth.
CURVE_PRIOR = 50.0
MOST_WEIGHT = 3.0
PRIOR = 0.4
LARGEST = 12.0
#: Steps of log odds that a byte holds, and that one unit is.
ODDS_STEPS, MOST_ODDS = 14, 9
#: Distinct pairs of context and symbol whose decisions are counted together.
PAIRS = 1 << 16

_MIX = np.uint32(0x9E3779B1)


def hashed(*parts: np.ndarray) -> np.ndarray:
    """One 32-bit hash of some whole numbers by position."""
    out = np.uint32(0x811C9DC5)
    for part in parts:
        out = (out ^ part.astype(np.uint32)) * np.uint32(0x01000193)
        out = out ^ (out >> np.uint32(15))
    return out * _MIX


class Code:
    """A Huffman code of symbols 0 to n - 1; every symbol has a spelling, and the code is complete."""

    def __init__(self, masses: np.ndarray):
        n = len(masses)
        heap = [(int(m) + 1, s) for s, m in enumerate(masses)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            one, other = heapq.heappop(heap), heapq.heappop(heap)
            children.append((one[1], other[1]))
            heapq.heappush(heap, (one[0] + other[0], n + len(children) - 1))
        paths: list[list[int]] = [[] for _ in range(n)]
        walk = [(n + len(children) - 1, [])] if children else []
        while walk:
            node, path = walk.pop()
            for bit, child in enumerate(children[node - n]):
                further = [*path, (node - n) * 2 + bit]
                if child < n:
                    paths[child] = further
                else:
                    walk.append((child, further))
        self.nodes = max(1, n - 1)
        self.lengths = np.array([len(p) for p in paths], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = np.array([x for p in paths for x in p], np.int64)
        self.node, self.bit = (flat >> 1).astype(np.uint32), (flat & 1).astype(np.uint8)
        self.mark = hashed(self.node)
        depth = np.concatenate([np.arange(k) for k in self.lengths]) if n > 1 else flat
        self.depth = np.searchsorted((1, 3, 6), depth, side="right").astype(np.uint8)


@dataclass
class Decisions:
    """All decisions of some symbols in order: the symbol's place, the decision's place in the code, and cells by context."""

    owner: np.ndarray
    at: np.ndarray
    bit: np.ndarray
    cells: list[np.ndarray]


class Tables:
    """Contexts of so many bits each; 0 bits: no context, a cell for each node of the code."""

    def __init__(self, code: Code, bits: tuple[int, ...]):
        self.code, self.bits = code, bits

    def empty(self) -> list[np.ndarray]:
        """Counts of zeros and ones by cell, flat (cell * 2 + bit)."""
        return [np.zeros((2 << b) if b else 2 * self.code.nodes, np.int64) for b in self.bits]

    def decisions(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> Decisions:
        lengths = self.code.lengths[symbols]
        owner = np.repeat(np.arange(len(symbols), dtype=np.int32), lengths)
        first = self.code.starts[symbols] - (np.cumsum(lengths) - lengths)
        at = np.repeat(first, lengths) + np.arange(len(owner))
        mark = self.code.mark.take(at)
        cells = [
            (((np.repeat(c, lengths) ^ mark) * _MIX) >> np.uint32(32 - b)) if b else self.code.node.take(at)
            for c, b in zip(contexts, self.bits, strict=True)
        ]
        return Decisions(owner, at, self.code.bit.take(at), cells)

    def note(self, counts: list[np.ndarray], d: Decisions, weight: np.ndarray | None = None) -> None:
        """Add decisions to counts, each as often as its weight says."""
        for table, cells in zip(counts, d.cells, strict=True):
            at = (cells.astype(np.int64) << 1) | d.bit
            if weight is None:
                np.add.at(table, at, 1)
            else:
                np.add.at(table, at, weight)

    def note_all(self, counts: list[np.ndarray], symbols: np.ndarray, contexts: list[np.ndarray]) -> None:
        """note of all decisions of symbols in contexts: each context spells its distinct pairs once, as often as they occur."""
        for k, (table, b) in enumerate(zip(counts, self.bits, strict=True)):
            key = symbols.astype(np.uint64)
            if b:
                key |= contexts[k].astype(np.uint64) << np.uint64(32)
            key.sort()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times, key = np.diff(np.append(cuts, len(key))), key[cuts]
            one = Tables(self.code, (b,))
            for at in range(0, len(key), PAIRS):
                rows = slice(at, at + PAIRS)
                d = one.decisions((key[rows] & np.uint64(0xFFFFFFFF)).astype(np.int64), [(key[rows] >> np.uint64(32)).astype(np.uint32)])
                one.note([table], d, times[rows].take(d.owner))


def evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds in steps, one byte each."""
    odds = np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -MOST_ODDS, MOST_ODDS)
    return np.rint(odds * ODDS_STEPS).astype(np.int8)


def known_class(n: np.ndarray) -> np.ndarray:
    """Class of the evidence in a cell: little, some, much."""
    return ((n > 1.5).astype(np.uint8) + (n > 15.5)).astype(np.uint8)


class Mixer:
    """Weights by mixer, and maps by depth and bucket of (ones, all). Decisions come sorted by mixer."""

    def __init__(self, inputs: int):
        self.weights = np.full((MIXERS, inputs + 1), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.refine = np.zeros((DEPTHS * MAP_BUCKETS, 2))
        self.curve = np.tile(np.eye(inputs + 1) * CURVE_PRIOR, (MIXERS, 1, 1))

    def logit(self, edges: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        """edges: where each mixer's decisions begin; inputs: one row for each input."""
        x = np.empty(inputs.shape[1], np.float32)
        for m in np.flatnonzero(np.diff(edges)):
            np.matmul(self.weights[m], inputs[:, edges[m] : edges[m + 1]], out=x[edges[m] : edges[m + 1]])
        return np.clip(x, -LARGEST, LARGEST, out=x)

    @staticmethod
    def _buckets(depth: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = (x + np.float32(LARGEST)) * np.float32((MAP_BUCKETS - 1) / (2 * LARGEST))
        low = np.minimum(where.astype(np.intp), MAP_BUCKETS - 2)
        return depth * np.intp(MAP_BUCKETS) + low, where - low.astype(np.float32)

    def probability(self, depth: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of a one: the mean of the mixed and the refined prediction."""
        return self.rated(depth, x)[0]

    def rated(self, depth: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """probability, and what learn can use again."""
        prior = np.tile(_squash(np.linspace(-LARGEST, LARGEST, MAP_BUCKETS)), DEPTHS)
        mapped = ((self.refine[:, 0] + 4 * prior) / (self.refine[:, 1] + 4)).astype(np.float32)
        low, upper = self._buckets(depth, x)
        plain, below = _squash(x), mapped.take(low)
        refined = below + (mapped[1:].take(low) - below) * upper
        return np.clip((plain + refined) * np.float32(0.5), np.float32(1e-6), np.float32(1 - 1e-6)), (low, upper, plain)

    def learn(self, edges: np.ndarray, inputs: np.ndarray, bit: np.ndarray, learnt: np.ndarray, known: tuple) -> None:
        """Note the outcomes in the maps; move each mixer by the gradient over the curvature gathered so far (an online Newton step).

        learnt: 1 for decisions to learn from, else 0; known: by rated. Without anything to learn nothing moves.
        """
        if not learnt.any():
            return
        low, upper, p = known
        size = len(self.refine)
        place = low * 2 + bit
        whole, above = (np.bincount(place, share, 2 * size).reshape(size, 2) for share in (learnt, upper * learnt))
        for share, first in ((whole - above, 0), (above, 1)):
            self.refine[first:] += np.stack([share[:, 1], share.sum(axis=1)], axis=1)[: size - first]
        bend, off = p * (1 - p) * learnt, (bit - p) * learnt
        slope, curve = np.zeros((MIXERS, len(inputs), 1)), np.zeros(self.curve.shape)
        for m in np.flatnonzero(np.diff(edges)):
            rows = slice(edges[m], edges[m + 1])
            part = inputs[:, rows]
            for k, row in enumerate(part):  # half of it, row by row: faster than so flat a product of matrices
                curve[m, k, k:] = curve[m, k:, k] = part[k:] @ (row * bend[rows])
            slope[m, :, 0] = part @ off[rows]
        self.curve += curve
        moved = self.weights + np.linalg.solve(self.curve, slope)[:, :, 0]
        self.weights = np.clip(moved, -MOST_WEIGHT, MOST_WEIGHT).astype(np.float32)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Predictor:
    """Predictions from counts; a decision that is itself among the counts is left out of them."""

    def __init__(self, tables: Tables, counts: list[np.ndarray], gates: tuple[int, int], mixer: Mixer | None = None):
        """counts: as Tables.empty(); gates: the contexts whose evidence chooses the mixer."""
        self.tables, self.gates = tables, gates
        self.mixer = mixer or Mixer(len(tables.bits))
        self.odds, code = [], tables.code
        for k, table in enumerate(counts):
            zeros, ones = table[0::2].astype(np.float32), table[1::2].astype(np.float32)
            odds = np.empty((len(zeros), 3), np.int8)
            odds[:, 0] = evidence(zeros, ones)
            odds[:, 1] = evidence(np.maximum(zeros - 1, 0), ones)
            odds[:, 2] = evidence(zeros, np.maximum(ones - 1, 0))
            if k in gates:  # evidence in the low byte, its class in the high one
                odds = odds.view(np.uint8).astype(np.uint16)
                odds[:, 0] |= known_class(zeros + ones).astype(np.uint16) << 8
                odds[:, 1:] |= known_class(zeros + ones - 1).astype(np.uint16)[:, None] << 8
            if not tables.bits[k]:  # by place in the code, whether it is among the counts
                odds = np.stack([odds[code.node, 0], odds[code.node, code.bit + np.uint8(1)]], axis=1)
            self.odds.append(odds.ravel())

    def anew(self) -> Predictor:
        """The same evidence and mixer, which learns apart from this one."""
        other = copy.copy(self)
        other.mixer = copy.deepcopy(self.mixer)
        return other

    def predict(self, symbols: np.ndarray, contexts: list[np.ndarray], counted: np.ndarray, learnt: np.ndarray):
        """Order of the decisions by mixer, edges of the mixers, and in that order inputs, bits and whether they are learnt from.

        counted: by symbol, whether it is among the counts.
        """
        code, bits = self.tables.code, self.tables.bits
        lengths = code.lengths.take(symbols)
        ends = np.cumsum(lengths)
        at = np.repeat(code.starts.take(symbols) - (ends - lengths), lengths)
        at += np.arange(len(at))
        mark, bit = code.mark.take(at), code.bit.take(at)
        inside = np.repeat(counted.view(np.uint8), lengths)
        which, known, width = (bit + np.uint8(1)) * inside, {}, len(bits) + 1
        rows = np.empty((len(at), -(-width // 8) * 8), np.int8)  # evidence by context, then bit and learnt
        for k, (table, b) in enumerate(zip(self.odds, bits, strict=True)):
            if b:
                cells = np.repeat(contexts[k], lengths)
                cells ^= mark
                cells *= _MIX
                cells >>= np.uint32(32 - b)
                cells *= np.uint32(3)
                cells += which
                odds = table.take(cells, mode="clip")
            else:
                odds = table.take(at * 2 + inside)
            if k in self.gates:
                known[k] = (odds >> np.uint16(8)).astype(np.uint8)
            rows[:, k] = odds.astype(np.uint8).view(np.int8)
        rows[:, len(bits)] = bit | np.repeat(learnt.view(np.uint8) << np.uint8(1), lengths)
        one, other = (known[g] for g in self.gates)
        mixer = (code.depth.take(at) * np.uint8(KNOWN_CLASSES) + one) * np.uint8(KNOWN_CLASSES) + other
        order = np.argsort(mixer, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(mixer, minlength=MIXERS))])
        rows = rows.view(np.int64).take(order, axis=0).view(np.int8)
        inputs = np.empty((width, len(order)), np.float32)
        for k in range(len(bits)):
            np.multiply(rows[:, k], np.float32(1 / ODDS_STEPS), out=inputs[k])
        inputs[-1] = 0.25
        flags = np.ascontiguousarray(rows[:, len(bits)]).view(np.uint8)
        return order, edges, inputs, flags & np.uint8(1), (flags >> np.uint8(1)).astype(np.float32)

    def run(self, batches) -> Iterator[np.ndarray]:
        """log10 probabilities of the symbols of each batch (symbols, contexts, counted, learnt), in order.

        learnt: by symbol, whether mixers and maps learn from it. Before anything has been
        learnt, a batch teaches before it is scored, with itself left out of all counts.
        """
        lengths = self.tables.code.lengths
        for symbols, contexts, counted, learnt in batches:
            if not lengths.take(symbols).any():  # nothing, or a code of one symbol
                yield np.zeros(len(symbols))
                continue
            order, edges, inputs, bit, part = self.predict(symbols, contexts, counted, learnt)
            depth = np.repeat(np.arange(MIXERS) // GATES, np.diff(edges))
            x = self.mixer.logit(edges, inputs)
            p, known = self.mixer.rated(depth, x)
            if fresh := not self.mixer.refine.any():
                self.mixer.learn(edges, inputs, bit, part, known)
                p, known = self.mixer.rated(depth, self.mixer.logit(edges, inputs))
            cost = np.empty(len(order))
            cost[order] = np.log(np.abs((1 - bit) - p))
            size = lengths.take(symbols)
            yield np.add.reduceat(cost, np.cumsum(size) - size) / np.log(10)
            if not fresh:
                self.mixer.learn(edges, inputs, bit, part, known)
