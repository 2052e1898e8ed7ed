"""Piece lattices of text units and sampling without replacement from them, with numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from tickloom.llm.wordtable import ragged_take

SPACE = "▁"  # stands for a space inside pieces
LITERAL = 0x110000  # a sign of the text that looks like SPACE; no code point, so no piece has it
LONGEST_UNIT = 256
#: Pieces have spaces at their front only and no line feed, so no piece crosses a border of these units.
UNIT = re.compile("\n| {1,%d}[^ \n%s]{0,%d}|[^ \n%s]{1,%d}|%s" % (LONGEST_UNIT, SPACE, LONGEST_UNIT, SPACE, LONGEST_UNIT, SPACE))
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed(key: np.ndarray, *parts) -> np.ndarray:
    """The key with parts mixed in: ``uniform(mixed(key, a), b)`` equals ``uniform(key, a, b)``."""
    x = key
    for p in parts:
        x = _mix(x + np.asarray(p).astype(np.uint64) * np.uint64(_P) + np.uint64(1))
    return x


def uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) that the key and the parts fix."""
    return ((_mix(mixed(key, *parts)) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces with log weights, looked up by a hash of their characters."""

    def __init__(self, pieces: dict[str, int], weights: dict[int, float], byte_ids: list[int]):
        names = list(pieces)
        self.longest = max(map(len, names))
        self.pow, self.inv = _powers(_P, 1 << 16), _powers(_P_INV, 1 << 16)
        h = np.concatenate([self._hash(np.array([ord(c) for c in p], np.uint64), len(p)) for p in names])
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array([pieces[p] for p in names], np.int64)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece, and this says so at once
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.begins = self.maybe.copy()  # the same for the fronts of pieces; a substring that is none cannot grow to a piece
        fronts = {p[:k] for p in names for k in range(1, len(p))}
        self.begins[np.concatenate([self._hash(np.array([ord(c) for c in p], np.uint64), len(p)) for p in fronts] or [self.hashes[:0]]) >> np.uint64(44)] = True
        self.weights = np.array([weights[i] for i in self.ids], np.float64)
        self.unknown = float(self.weights.min()) - 10.0
        self.byte_ids = np.array(byte_ids, np.int64)

    def _hash(self, points: np.ndarray, length: int) -> np.ndarray:
        return _mix((points * self.pow[:length]).sum(dtype=np.uint64, keepdims=True) + np.uint64(length))

    @classmethod
    def load(cls, path: str, alpha: float = 1.0) -> tuple[Vocabulary, list[bytes]]:
        """Vocabulary of a SentencePiece model file and the bytes of each id.

        The weight is alpha times the log probability: the score itself for a unigram model. A merge
        model ranks its pieces by frequency; there the probability falls as one over the rank.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in plain}
        ranked = all(s <= 0 and s == int(s) for s in score.values())
        weights = {i: alpha * (-float(np.log(r + 2.0)) if ranked else score[i]) for r, i in enumerate(sorted(plain, key=lambda i: (-score[i], i)))}
        data = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if i not in score else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        byte_ids = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[data[i][0]] = i
        return cls({sp.id_to_piece(i): i for i in plain}, weights, byte_ids), data


class Lattices:
    """Lattices of units, kept for reuse up to ``limit`` units; beyond it those not met again are dropped.

    States are places inside a unit; the edges of a state carry the share of all segmentations from
    there on that begin with them, so walking by these shares samples a segmentation exactly.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 120_000):
        self.vocabulary, self.limit = vocabulary, limit
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.n_states = self.n_edges = 0
        self.unit_state, self.first_edge = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.upto, self.logp = np.zeros(0), np.zeros(0)
        self.next, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)  # units met in a later call than their first

    def _trim(self) -> None:
        """Drop the units that no later call has asked for; all of them if that leaves too many."""
        keep = np.flatnonzero(self.again[:len(self.slot)])
        if 4 * len(keep) > 3 * self.limit:
            self._clear()
            return
        units = list(self.slot)
        state0 = self.unit_state[:len(units)]
        per_unit = np.diff(np.append(state0, self.n_states))[keep]
        states = ragged_take(np.arange(self.n_states), state0[keep], per_unit)
        first = self.first_edge[:self.n_states + 1]
        per_state = np.diff(first)[states]
        edges = ragged_take(np.arange(self.n_edges), first[states], per_state)
        new_state = np.full(self.n_states, -1, np.int64)
        new_state[states] = np.arange(len(states))
        to = self.next[edges]
        self.slot = dict(zip([units[i] for i in keep.tolist()], range(len(keep))))
        self.upto, self.logp, self.piece = self.upto[edges], self.logp[edges], self.piece[edges]
        self.next = np.where(to < 0, -1, new_state[to]).astype(np.int32)
        self.first_edge = np.concatenate([[0], np.cumsum(per_state)])
        self.unit_state = np.cumsum(per_unit) - per_unit
        self.again = np.zeros(len(keep), bool)
        self.n_states, self.n_edges = len(states), len(edges)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into an array that doubles when it is full."""
        array = getattr(self, name)
        if at + len(values) > len(array):
            array = np.concatenate([array, np.zeros(at + len(values), array.dtype)])
            setattr(self, name, array)
        array[at:at + len(values)] = values

    def slots(self, units: list[str]) -> np.ndarray:
        if len(self.slot) > self.limit:
            self._trim()
        out = np.fromiter(map(self.slot.get, units, [-1] * len(units)), np.int64, len(units))
        gaps = np.flatnonzero(out < 0)
        self.again[out[out >= 0]] = True
        if len(gaps):
            missing = [units[i] for i in gaps.tolist()]
            new = list(dict.fromkeys(missing))
            for i in range(0, len(new), 16000):
                self._add(new[i:i + 16000])
            out[gaps] = np.fromiter(map(self.slot.get, missing), np.int64, len(missing))
        return out

    def _add(self, units: list[str]) -> None:
        v = self.vocabulary
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        points = np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        points = np.where(points == ord(SPACE), LITERAL, np.where(points == 32, ord(SPACE), points)).astype(np.uint64)
        end_of = np.repeat(ends, lengths)
        # hashes start anew in every unit, so powers stay short
        within = np.arange(n) - np.repeat(ends - lengths, lengths)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * v.pow[within], dtype=np.uint64)])
        where, length, piece, weight = [], [], [], []
        single = np.zeros(n, bool)
        at = np.arange(n)
        for size in range(1, v.longest + 1):
            at = at[at + size <= end_of[at]]
            if not len(at):
                break
            h = _mix((sums[at + size] - sums[at]) * v.inv[within[at]] + np.uint64(size))
            top = h >> np.uint64(44)
            begins = v.begins[top]
            at, h, top = at[begins], h[begins], top[begins]
            likely = np.flatnonzero(v.maybe[top])
            h = h[likely]
            j = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
            hit = v.hashes[j] == h
            where.append(at[likely[hit]])
            length.append(np.full(len(where[-1]), size))
            piece.append(v.ids[j[hit]])
            weight.append(v.weights[j[hit]])
            if size == 1:
                single[where[0]] = True
                lone = np.flatnonzero(~single)  # characters without a piece are spelled in bytes
                where.append(lone)
                length.append(np.ones(len(lone), np.int64))
                piece.append(-points[lone].astype(np.int64) - 1)
                weight.append(np.full(len(lone), v.unknown))
        where, length, piece, weight = (np.concatenate(x) for x in (where, length, piece, weight))
        order = np.argsort(where * (v.longest + 1) + length)
        where, length, piece, weight = (x[order] for x in (where, length, piece, weight))
        to, last = where + length, end_of[where]
        away = (last - where).astype(np.int16 if lengths.max() < 1 << 15 else np.int64)
        below = np.zeros(n + 1)
        value = np.empty(len(where))
        level = np.argsort(away, kind="stable")
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(away[level])) + 1, [len(away)]])
        for a, b in zip(bounds[:-1], bounds[1:]):  # from the ends of the units to their fronts
            edges = level[a:b]
            here, target = where[edges], to[edges]
            val = weight[edges] + np.where(target == last[edges], 0.0, below[target])
            heads = np.concatenate([[0], np.flatnonzero(np.diff(here)) + 1])
            top = np.maximum.reduceat(val, heads)
            per = np.diff(np.concatenate([heads, [b - a]]))
            total = top + np.log(np.add.reduceat(np.exp(val - np.repeat(top, per)), heads))
            below[here[heads]] = total
            value[edges] = val - np.repeat(total, per)
        count = np.bincount(where, minlength=n)
        first = np.cumsum(count) - count
        run = np.cumsum(np.exp(value))
        upto = run - np.concatenate([[0.0], run])[np.repeat(first, count)]
        closing = first + count - 1
        upto[closing] = 1.0
        value[first[count == 1]] = 0.0
        state0, edge0, slot0 = self.n_states, self.n_edges, len(self.slot)
        self._put("upto", edge0, upto)
        self._put("logp", edge0, np.minimum(value, 0.0))
        self._put("next", edge0, np.where(to == last, -1, to + state0))
        self._put("piece", edge0, piece)
        self._put("first_edge", state0 + 1, edge0 + np.cumsum(count))
        self._put("unit_state", slot0, state0 + ends - lengths)
        self._put("again", slot0, np.zeros(len(units), bool))
        self.n_states, self.n_edges = state0 + n, edge0 + len(where)
        self.slot.update(zip(units, range(slot0, slot0 + len(units))))

    def walk(self, state: np.ndarray, key: np.ndarray, unit: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of one segmentation of each unit from ``state`` on, drawn by (key, sample, unit): row, step and edge, rows in order."""
        rows, edges, steps = [], [], []
        live, step = np.arange(len(state)), 0
        key = mixed(key, 2 * sample, unit)
        while len(live):
            u = uniform(key[live], step)
            e = self.first_edge[state]
            on = np.flatnonzero(self.upto[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.upto[e[on]] <= u[on]]
            rows.append(live)
            edges.append(e)
            steps.append(np.full(len(live), step))
            state = self.next[e]
            more = state >= 0
            live, state = live[more], state[more]
            step += 1
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        rows, edges, steps = np.concatenate(rows), np.concatenate(edges), np.concatenate(steps)
        order = np.argsort(rows, kind="stable")
        return rows[order], steps[order], edges[order]

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the edges, one after the other, and how many each edge has."""
        piece = self.piece[edges].astype(np.int64)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece, np.ones(len(piece), np.int64)
        signs, which = np.unique(piece[odd], return_inverse=True)
        spelled = [(SPACE if -s - 1 == LITERAL else chr(-s - 1)).encode("utf-8", "replace") for s in signs.tolist()]
        flat = np.concatenate([piece, self.vocabulary.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]])
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        start, length = np.arange(len(piece)), np.ones(len(piece), np.int64)
        start[odd], length[odd] = (len(piece) + np.cumsum(sizes) - sizes)[which], sizes[which]
        return ragged_take(flat, start, length), length


def truncated_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``location`` given that they are at most ``most``."""
    with np.errstate(over="ignore"):
        return location - np.log(np.exp(location - most) - np.log(u))


@dataclass
class Sample:
    edges: np.ndarray
    unit: np.ndarray  # of each edge
    prefix: np.ndarray  # log probability before each edge
    open: np.ndarray  # perturbed value of the best segmentation that leaves this one at the edge
    value: float
    logp: float


def top_k(lattices: Lattices, docs: list[list[str]], keys: np.ndarray, k: int) -> list[tuple[list[Sample], float]]:
    """k distinct segmentations of each document, by perturbed best-first search, and the value of the next best.

    The value of a node is the greatest Gumbel-perturbed log probability in its subtree. It is drawn
    from the top down: the root's value is free, the branch taken keeps its parent's value, and all
    branches not taken form one node whose value is drawn below it. The agenda's best node is then
    always the next sample, so the search expands k paths and nothing else.
    """
    n_units = np.fromiter(map(len, docs), np.int64, len(docs))
    slots = lattices.slots([u for d in docs for u in d])
    starts = np.cumsum(n_units) - n_units
    state = lattices.unit_state[slots]
    unit = np.arange(len(slots)) - np.repeat(starts, n_units)
    value = -np.log(-np.log(uniform(keys, 0, 0, 0)))
    out: list[list[Sample]] = [[] for _ in docs]
    dropped: list[dict] = [{} for _ in docs]

    def spread(which, rows, edges, doc_of_row, unit_of_row, before, most, sample) -> list[tuple]:
        """Values of the nodes beside freshly walked edges, document by document."""
        doc = doc_of_row[rows]
        logp = lattices.logp[edges]
        run = np.cumsum(logp) - logp
        count = np.bincount(doc, minlength=len(which))
        first = np.cumsum(count) - count
        base = np.where(count > 0, run[np.minimum(first, max(len(run) - 1, 0))], 0.0) if len(run) else np.zeros(len(which))
        prefix = run - base[doc] + before[doc]
        order = np.arange(len(edges)) - first[doc]
        with np.errstate(divide="ignore"):
            location = prefix + np.log(-np.expm1(logp))
        beside = truncated_gumbel(location, most[doc], uniform(mixed(keys[which], 2 * sample + 1)[doc], order, 7))
        beside[logp == 0.0] = -np.inf
        u = unit_of_row[rows]
        return [(edges[a:b], u[a:b], prefix[a:b], beside[a:b], float(logp[a:b].sum())) for a, b in zip(first.tolist(), (first + count).tolist())]

    which = np.arange(len(docs))
    doc_of = np.repeat(which, n_units)
    rows, _, edges = lattices.walk(state, keys[doc_of], unit, 0)
    for d, (e, u, pre, beside, logp) in enumerate(spread(which, rows, edges, doc_of, unit, np.zeros(len(docs)), value, 0)):
        out[d].append(Sample(e, u, pre, beside, float(value[d]), logp))

    for m in range(1, k):
        picked = []
        for d in range(len(docs)):
            node = _best(out[d])
            if node is not None:
                picked.append((d, *node))
        if not picked:
            break
        which = np.array([p[0] for p in picked])
        draw = uniform(keys[which], 2 * m, 1 << 40, 0)
        again = uniform(keys[which], 2 * m + 1, 1 << 40, 0)
        parts, branch = [], []
        for x, (d, j, i) in enumerate(picked):
            path = out[d][j]
            here = int(path.edges[i])
            s = int(np.searchsorted(lattices.first_edge[:lattices.n_states + 1], here, "right")) - 1
            a, b = int(lattices.first_edge[s]), int(lattices.first_edge[s + 1])
            gone = dropped[d].setdefault((j, i), [here])
            free = np.array([e for e in range(a, b) if e not in gone])
            share = np.exp(lattices.logp[free])
            e = int(free[min(np.searchsorted(np.cumsum(share), draw[x] * share.sum(), "right"), len(free) - 1)])
            most = float(path.open[i])
            gone.append(e)
            left = share.sum() - np.exp(lattices.logp[e]) if len(free) > 1 else 0.0
            path.open[i] = truncated_gumbel(np.float64(path.prefix[i] + np.log(left)), np.float64(most), again[x]) if left > 0 else -np.inf
            u = int(path.unit[i])
            then = [] if lattices.next[e] < 0 else [int(lattices.next[e])]
            tail = np.arange(starts[d] + u + 1, starts[d] + n_units[d])
            parts.append((np.concatenate([np.array(then, np.int64), state[tail]]), np.concatenate([np.full(len(then), u), unit[tail]])))
            branch.append((e, u, most, float(path.prefix[i] + lattices.logp[e])))
        sizes = np.array([len(p[0]) for p in parts])
        doc_of = np.repeat(np.arange(len(picked)), sizes)
        new_unit = np.concatenate([p[1] for p in parts])
        rows, _, edges = lattices.walk(np.concatenate([p[0] for p in parts]), keys[which][doc_of], new_unit, m)
        fresh = spread(which, rows, edges, doc_of, new_unit, np.array([b[3] for b in branch]), np.array([b[2] for b in branch]), m)
        for (d, j, i), (e, u, most, at), (tail, tail_unit, pre, beside, logp) in zip(picked, branch, fresh):
            path = out[d][j]
            shared = np.full(i + 1, -np.inf)  # these places are open on the path they come from
            out[d].append(Sample(np.concatenate([path.edges[:i], [e], tail]), np.concatenate([path.unit[:i], [u], tail_unit]),
                                 np.concatenate([path.prefix[:i + 1], pre]), np.concatenate([shared, beside]), most, at + logp))
    result = []
    for samples in out:
        node = _best(samples)
        result.append((samples, float(samples[node[0]].open[node[1]]) if node else -np.inf))
    return result


def _best(samples: list[Sample]) -> tuple[int, int] | None:
    """Path and place of the agenda's best node; None when every segmentation has been emitted."""
    best, at = -np.inf, None
    for j, s in enumerate(samples):
        if len(s.open):
            i = int(np.argmax(s.open))
            if s.open[i] > best:
                best, at = s.open[i], (j, i)
    return at


def log_inclusion(logp: float, threshold: float) -> float:
    """Log probability that a segmentation is among the k: its perturbed value passes the next best value."""
    x = logp - threshold
    return 0.0 if x > 30 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


def units_of(text: str | None) -> list[str]:
    """Units of a text behind the leading space that the vocabulary expects; none for an empty text."""
    return UNIT.findall(" " + text) if text else []
