"""Hierarchical navigable small-world graphs over unit vectors, built and searched many vectors at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a new node per layer; the bottom layer keeps twice as many. One more column holds bridges.
LINKS = 16
#: Nodes that enter together, queries that search together, and beam while building.
BATCH, QUERIES, BUILD_BEAM = 512, 256, 64


@dataclass
class Graph:
    """Unit vectors, the top layer of each, and per layer the links of each vector (-1: none)."""

    x: np.ndarray
    level: np.ndarray
    layers: list[np.ndarray]
    entry: int


def levels(random: np.ndarray) -> np.ndarray:
    """Top layer of each node from 64 random bits: one in LINKS nodes reaches the next layer."""
    u = ((random.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.minimum(-np.log(u) / np.log(LINKS), 8).astype(np.int64)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and cosines of the ``width`` nearest that a best-first search from ``entry`` reaches, for every query.

    All queries move together; each opens its best few unopened ids of the beam until none is left.
    """
    nq, n = len(q), len(x)
    ids, sims, fresh = np.full((nq, width), -1, np.int32), np.full((nq, width), -2, np.float32), np.zeros((nq, width), bool)
    ids[:, 0], sims[:, 0], fresh[:, 0] = entry, np.einsum("ij,ij->i", q, x[entry]), True
    met = np.full((nq, n), -1, np.int32)
    met[np.arange(nq), entry] = 0
    live, few = np.arange(nq), min(width, max(4, width // 16))
    while len(live):
        able = np.where(fresh[live], sims[live], np.float32(-3))
        pick = np.argpartition(-able, few - 1, axis=1)[:, :few] if few < width else np.broadcast_to(np.arange(width), able.shape)
        opened = np.take_along_axis(able, pick, 1) > -3
        near = np.where(opened[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        fresh[live[:, None], pick] = False
        row, col = np.nonzero(near >= 0)
        node, asks = near[row, col], live[row]
        new = met[asks, node] < 0
        row, node, asks = row[new], node[new], asks[new]
        met[asks, node] = np.arange(len(node), dtype=np.int32)
        once = met[asks, node] == np.arange(len(node))
        row, node, asks = row[once], node[once], asks[once]
        sim = np.einsum("ij,ij->i", q[asks], x[node])
        better = sim > sims.min(1)[asks]
        row, node, sim = row[better], node[better], sim[better]
        if len(row):
            count = np.bincount(row, minlength=len(live))
            spot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            some = np.flatnonzero(count)
            place = np.cumsum(count > 0) - 1
            more = int(count.max())
            all_ids, all_sims, all_fresh = (np.full((len(some), width + more), v, t) for v, t in ((-1, np.int32), (-2, np.float32), (False, bool)))
            at = live[some]
            all_ids[:, :width], all_sims[:, :width], all_fresh[:, :width] = ids[at], sims[at], fresh[at]
            all_ids[place[row], width + spot], all_sims[place[row], width + spot], all_fresh[place[row], width + spot] = node, sim, True
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[at], sims[at], fresh[at] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_fresh))
        live = live[fresh[live].any(1)]
    return ids, sims


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Of each row's candidates up to k that are nearer to the row's vector than to a chosen one, filled up with the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(ids, 0)]
    among = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        closest = np.where(chosen, among[:, c], np.float32(-2)).max(1)
        chosen[:, c] = (ids[:, c] >= 0) & (sims[:, c] > closest) & (chosen.sum(1) < k)
    first = np.argsort(~chosen * 2 + (ids < 0), axis=1, kind="stable")[:, :k]
    out = np.take_along_axis(ids, first, 1)
    return np.pad(out, ((0, 0), (0, max(0, k - out.shape[1]))), constant_values=-1)


def _join(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray, k: int) -> None:
    """Link new nodes to their chosen ones and back; a node with more than k links keeps k spread ones."""
    links[new, :chosen.shape[1]] = chosen
    row, col = np.nonzero(chosen >= 0)
    to, back = chosen[row, col], new[row]
    sim = np.einsum("ij,ij->i", x[to], x[back])
    order = np.lexsort((back, -sim, to))
    to, back, sim = to[order], back[order], sim[order]
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(start, count)
    keep = rank < k
    more = np.full((len(nodes), k), -1, np.int32)
    more[np.repeat(np.arange(len(nodes)), count)[keep], rank[keep]] = back[keep]
    both = np.concatenate([links[nodes, :k], more], 1)
    order = np.argsort(both < 0, axis=1, kind="stable")
    both = np.take_along_axis(both, order, 1)
    full = both[:, k:].max(1) >= 0
    links[nodes[~full], :k] = both[~full, :k]
    if full.any():
        ids = both[full]
        sims = np.where(ids >= 0, np.einsum("ik,ijk->ij", x[nodes[full]], x[np.maximum(ids, 0)]), np.float32(-2))
        links[nodes[full], :k] = _spread(x, ids, sims, k)


def _reached(links: np.ndarray, start: int, seen: np.ndarray) -> None:
    """Mark all nodes that links lead to from ``start``."""
    front = np.array([start])
    seen[start] = True
    while len(front):
        front = np.unique(links[front])
        front = front[front >= 0]
        front = front[~seen[front]]
        seen[front] = True


def _bridge(x: np.ndarray, links: np.ndarray, members: np.ndarray, start: int) -> None:
    """Lead a path to every member: an unreached one hangs in the spare column of the nearest reached node that has it free."""
    seen = np.zeros(len(x), bool)
    _reached(links, start, seen)
    while len(lost := members[~seen[members]]):
        some = lost[:BATCH]
        hosts = members[seen[members] & (links[members, -1] < 0)]
        near = x[some] @ x[hosts].T
        i, j = np.unravel_index(near.argmax(), near.shape)
        links[hosts[j], -1] = some[i]
        _reached(links, int(some[i]), seen)


def build(x: np.ndarray, level: np.ndarray) -> Graph:
    """Graph of unit vectors (float32); the same input gives the same graph.

    Layers are built from the top. In each, nodes of higher layers enter first, then batches that are at most
    as large as what is there: every node looks for neighbours among those that are in and among its batch.
    """
    n = len(x)
    order = np.argsort(-level, kind="stable").astype(np.int32)
    top = int(level.max(initial=0))
    layers: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * (top + 1)
    entry = int(order[0]) if n else -1
    for layer in range(top, -1, -1):
        members = order[:int((level >= layer).sum())]
        k = LINKS if layer else 2 * LINKS
        links = np.full((n, k + 1), -1, np.int32)
        inside, at = np.zeros(n, bool), 0
        while at < len(members):
            new = members[at:at + max(1, min(BATCH, at or k))]
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -2)
            near = np.argsort(-own, axis=1, kind="stable")[:, :k].astype(np.int32)
            sims = np.take_along_axis(own, near, 1)
            ids = np.where(sims > -2, new[near], -1)
            if at:
                start = descend(x, layers, entry, layer, x[new])
                found, fs = beam(x, links, x[new], np.where(inside[start], start, entry), min(BUILD_BEAM, at))
                ids, sims = np.concatenate([found, ids], 1), np.concatenate([fs, sims], 1)
            sims = np.where(ids >= 0, sims, np.float32(-2))
            _join(x, links, new, _spread(x, ids, sims, LINKS), k)
            inside[new] = True
            at += len(new)
        _bridge(x, links, members, entry)
        layers[layer] = links
    return Graph(x, level, layers, entry)


def descend(x: np.ndarray, layers: list[np.ndarray], entry: int, layer: int, q: np.ndarray) -> np.ndarray:
    """Where each query enters ``layer``: the nearest node found in the layers above."""
    at = np.full(len(q), entry, np.int64)
    for above in range(len(layers) - 1, layer, -1):
        ids, sims = beam(x, layers[above], q, at, 4)
        at = np.take_along_axis(ids, sims.argmax(1)[:, None], 1)[:, 0].astype(np.int64)
    return at


def within(g: Graph, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with cosine ``least`` or more that beams of ``width`` find.

    Where a whole beam is that near, the beam of the query doubles; a beam as wide as the graph is a comparison with all of it.
    """
    rows, nodes = [], []
    for lo in range(0, len(q), QUERIES):
        todo, w = np.arange(lo, min(lo + QUERIES, len(q))), width
        start = descend(g.x, g.layers, g.entry, 0, q[todo])
        while len(todo):
            if w >= len(g.x):
                sims = q[todo] @ g.x.T
                ids = np.broadcast_to(np.arange(len(g.x)), sims.shape)
            else:
                ids, sims = beam(g.x, g.layers[0], q[todo], start, w)
            hit = (sims >= least) & (ids >= 0)
            done = ~hit.all(1) if w < len(g.x) else np.ones(len(todo), bool)
            r, c = np.nonzero(hit & done[:, None])
            rows.append(todo[r])
            nodes.append(ids[r, c].astype(np.int64))
            todo, start, w = todo[~done], start[~done], 2 * w
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
