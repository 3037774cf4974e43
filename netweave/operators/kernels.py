"""Small numpy kernels on one network: potentials, supports, values and flows for all destinations at once.

Arrays are (nodes or links) x destinations. Spark decides which networks or deposits meet which task; a kernel only
does the rounds of one of them, a few matrix operations each.
"""

from __future__ import annotations

import numpy as np


class Graph:
    """Links sorted once by tail, with the transit rule of the network."""

    def __init__(self, n_nodes: int, n_zones: int, tail: np.ndarray, head: np.ndarray, no_thru: bool, zero_connectors: bool):
        self.n, self.z, self.tail, self.head, self.no_thru, self.zdc = n_nodes, n_zones, tail, head, no_thru, zero_connectors
        self.by_tail = np.argsort(tail, kind="stable")
        self.tails, self.tail_at = np.unique(tail[self.by_tail], return_index=True)
        dest = np.arange(n_zones)
        self.to_dest, self.from_dest = head[:, None] == dest, tail[:, None] == dest
        #: a link into a zone that isn't the destination is no way through, where the network says so
        self.barred = no_thru & (head < n_zones)[:, None] & ~self.to_dest

    def out_reduce(self, ufunc, links: np.ndarray, empty: float) -> np.ndarray:
        """Reduce a links x destinations array over the links that leave each node."""
        out = np.full((self.n, links.shape[1]), empty)
        out[self.tails] = ufunc.reduceat(links[self.by_tail], self.tail_at, axis=0)
        return out

    def potentials(self, cost: np.ndarray) -> np.ndarray:
        """Least cost from each node to each zone; infinite where there is no way."""
        pi = np.full((self.n, self.z), np.inf)
        pi[np.arange(self.z), np.arange(self.z)] = 0.0
        own = pi.copy()
        while True:
            via = np.where(self.barred, np.inf, cost[:, None] + pi[self.head])
            new = np.minimum(own, self.out_reduce(np.minimum, via, np.inf))
            if np.array_equal(new, pi):
                return pi
            pi = new

    def support(self, pi: np.ndarray) -> np.ndarray:
        """The efficient links of each destination."""
        t, h = pi[self.tail], pi[self.head]
        # the first rule that speaks wins, as in operators.graph.efficient
        rules = [(self.from_dest, False), (self.to_dest, True), (self.no_thru & (self.head < self.z)[:, None], False), (self.zdc & (self.tail < self.z)[:, None], True)]
        said = np.select([np.broadcast_to(c, t.shape) for c, _ in rules], [np.full(t.shape, v) for _, v in rules], h < t)
        return said & np.isfinite(t) & np.isfinite(h)

    def load(self, cost: np.ndarray, demand: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray, Support]:
        """Flow, potentials and support at a cost; demand that no way serves stays out."""
        pi = self.potentials(cost)
        support = Support(self, self.support(pi), pi)
        p, _ = support.chances(cost, pi, mu)
        return support.push(p, np.where(np.isfinite(pi), demand, 0.0)), pi, support


class Support:
    """The links of all destinations' supports, sorted once by the level of their tail (hops to the destination, at most).

    A pass then visits every pair of link and destination once, level by level. Supports of destinations whose links
    close a cycle keep only links of falling potential, which can't; ``cyclic`` tells which those are.
    """

    def __init__(self, g: Graph, mask: np.ndarray, pi: np.ndarray):
        self.g, self.cyclic = g, np.zeros(g.z, bool)
        level = self._levels(g, mask)
        if level.max(initial=0) > g.n:
            self.cyclic = level.max(0) > g.n
            with np.errstate(invalid="ignore"):
                falling = (pi[g.head] < pi[g.tail]) & mask
            mask = np.where(self.cyclic, falling, mask)
            level = self._levels(g, mask)
        self.mask = mask
        link, dest = np.nonzero(mask)
        order = np.lexsort((g.tail[link] * g.z + dest, level[g.tail[link], dest]))
        self.link, self.dest = link[order], dest[order]
        self.tail_at, self.head_at = g.tail[self.link] * g.z + self.dest, g.head[self.link] * g.z + self.dest
        levels = level.reshape(-1)[self.tail_at]
        self.cuts = np.append(np.flatnonzero(np.append(True, np.diff(levels) > 0)), len(levels)) if len(levels) else np.zeros(1, int)
        first = np.append(True, np.diff(self.tail_at) != 0) if len(levels) else np.zeros(0, bool)
        #: per level: the pairs, where a new tail begins among them, and those tails
        self.steps = []
        for s, e in zip(self.cuts[:-1], self.cuts[1:]):
            at = np.flatnonzero(first[s:e])
            self.steps.append((slice(s, e), at, self.tail_at[s:e][at]))

    @staticmethod
    def _levels(g: Graph, mask: np.ndarray) -> np.ndarray:
        level = np.zeros((g.n, g.z), np.int64)
        for _ in range(g.n + 1):
            new = g.out_reduce(np.maximum, np.where(mask, level[g.head] + 1, 0), 0).astype(np.int64)
            if np.array_equal(new, level):
                break
            level = new
        return level

    def chances(self, cost: np.ndarray, pi: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
        """Choice probability of each pair, and the log-sum-exp value of each node and destination."""
        g, flat = self.g, pi.reshape(-1)
        share = np.exp(np.clip(-mu * (cost[self.link] + flat[self.head_at] - flat[self.tail_at]), -700, 50))
        w = np.zeros(g.n * g.z)
        w[np.arange(g.z) * (g.z + 1)] = 1.0
        for pairs, at, tails in self.steps:
            w[tails] = np.add.reduceat(share[pairs] * w[self.head_at[pairs]], at)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(w[self.tail_at] > 0, share * w[self.head_at] / w[self.tail_at], 0.0)
            value = np.where(w > 0, np.log(w) - mu * flat, -np.inf)
        return p, value.reshape(g.n, g.z)

    def push(self, p: np.ndarray, demand: np.ndarray) -> np.ndarray:
        """Link flows of a demand (nodes x destinations) under the probabilities; a destination absorbs."""
        z, flow = demand.reshape(-1).copy(), np.zeros(len(p))
        for pairs, _, _ in reversed(self.steps):
            moved = p[pairs] * z[self.tail_at[pairs]]
            flow[pairs] = moved
            np.add.at(z, self.head_at[pairs], moved)
        return np.bincount(self.link, flow, len(self.g.tail))


def bpr(x: np.ndarray, fft: np.ndarray, capacity: np.ndarray, b: np.ndarray, power: np.ndarray) -> np.ndarray:
    """The link cost of netweave.functions.costs, on arrays."""
    cap = 10.0 ** (250 / np.maximum(power, 1e-12))
    return fft * (1 + b * np.clip(np.maximum(x, 0) / np.maximum(capacity, 1e-9), 0, cap) ** power)


def zone_demand(n_nodes: int, n_zones: int) -> np.ndarray:
    """Demand of each node (row) to each zone: the rule of operators.graph.demand."""
    o, d = np.arange(n_zones)[:, None], np.arange(n_zones)[None, :]
    out = np.zeros((n_nodes, n_zones))
    out[:n_zones] = np.where(o == d, 0.0, 10.0 * (1 + (o * 7 + d * 13) % 10) / n_zones)
    return out
