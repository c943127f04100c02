"""A learned partition of unit vectors: the index behind the neighbour and cluster operators (problems 3 and 4).

A bounded sample's neighbour graph is cut into parts of equal size with few edges between them, and a small
classifier learns from it in which parts a vector's neighbours lie. The classifier then places every vector,
and sends a query to its several most probable parts.
"""

from __future__ import annotations

import numpy as np

#: Vectors of the sample that a model is fitted on, at most. Every vector is placed by the model.
FIT_ROWS = 12_000
#: Neighbours of a sample vector in the graph that is partitioned.
GRAPH_NEIGHBOURS = 10
#: Parts of one model, at most: each keeps enough of the sample to be learned.
MAX_PARTS = 128
HIDDEN = 128
EPOCHS = 12
BLOCK = 512


def nearest(queries: np.ndarray, base: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(similarity, row of base)`` of the k best for each query, unordered; ``own``: the row of each query itself, left out."""
    k = min(k, len(base) - (own is not None))
    sims, rows = np.empty((len(queries), max(k, 0)), np.float32), np.empty((len(queries), max(k, 0)), np.int64)
    if k < 1:
        return sims, rows
    for b in range(0, len(queries), BLOCK):
        s = queries[b : b + BLOCK] @ base.T
        if own is not None:
            s[np.arange(len(s)), own[b : b + BLOCK]] = -np.inf
        top = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:]
        rows[b : b + BLOCK], sims[b : b + BLOCK] = top, np.take_along_axis(s, top, 1)
    return sims, rows


def _bisect(x: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    """Parts of equal size by repeated cuts across the main direction: where the refinement starts."""
    if parts == 1 or len(rows) < 2:
        out[rows] = first
        return
    y = x[rows] - x[rows].mean(0)
    direction = np.ones(y.shape[1], np.float32)
    cov = y.T @ y
    for _ in range(12):
        direction = cov @ direction
        direction /= np.linalg.norm(direction) + 1e-12
    left = parts // 2
    order = np.argsort(y @ direction, kind="stable")
    cut = len(rows) * left // parts
    _bisect(x, rows[order[:cut]], left, first, out)
    _bisect(x, rows[order[cut:]], parts - left, first + left, out)


def balanced_cut(graph: np.ndarray, start: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 8) -> np.ndarray:
    """Move vertices to the part most of their neighbours are in, while no part grows beyond ``(1 + slack)`` of its share."""
    n, label = len(graph), start.copy()
    room = int(np.ceil(n / parts * (1 + slack)))
    back = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (back[0], label[back[1]]), 1)
        np.add.at(votes, (back[1], label[back[0]]), 1)
        gain = votes - votes[np.arange(n), label][:, None]
        best = gain.argmax(1)
        wish = np.flatnonzero(gain[np.arange(n), best] > 0)
        wish = wish[np.argsort(-gain[wish, best[wish]], kind="stable")]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in wish:
            to, old = best[v], label[v]
            if size[to] < room:
                size[to] += 1
                size[old] -= 1
                label[v] = to
                moved += 1
        if moved < n // 200:
            break
    return label


class LearnedPartition:
    """Parts of a vector space and the classifier that finds them. Plain arrays, so it travels with a task."""

    def __init__(self, parts: int, weights: tuple[np.ndarray, ...] | None, load: np.ndarray):
        self.parts, self.weights, self.load = parts, weights, load

    @classmethod
    def fit(cls, sample: np.ndarray, parts: int, seed: int = 3) -> LearnedPartition:
        """``sample``: unit vectors. With fewer than two parts, or too few vectors to learn from, everything is one part."""
        n = len(sample)
        parts = min(parts, n // (4 * GRAPH_NEIGHBOURS), MAX_PARTS)
        if parts < 2:
            return cls(1, None, np.ones(1))
        _, graph = nearest(sample, sample, GRAPH_NEIGHBOURS, np.arange(n))
        start = np.zeros(n, np.int64)
        _bisect(sample, np.arange(n), parts, 0, start)
        label = balanced_cut(graph, start, parts)
        target = np.zeros((n, parts), np.float32)  # where a vector's neighbours are, and itself
        np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        target[np.arange(n), label] += graph.shape[1] / 2
        target /= target.sum(1, keepdims=True)
        return cls(parts, _train(sample, target, seed), np.bincount(label, minlength=parts) / n)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each vector, best first."""
        if self.weights is None or not len(x):
            return np.zeros((len(x), 1), np.int32)
        probes = min(probes, self.parts)
        out = np.empty((len(x), probes), np.int32)
        for b in range(0, len(x), 8192):
            s = self.scores(x[b : b + 8192])
            top = np.argpartition(s, s.shape[1] - probes, axis=1)[:, -probes:]
            order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
            out[b : b + 8192] = np.take_along_axis(top, order, 1)
        return out


def _train(x: np.ndarray, target: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """One hidden layer and a softmax, fitted with Adam."""
    rng = np.random.default_rng(seed)
    d, m = x.shape[1], target.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, m)), np.zeros(m)]
    w = [a.astype(np.float32) for a in w]
    mean, square, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for b in range(0, len(x), 256):
            rows = order[b : b + 256]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            s = np.exp(s - s.max(1, keepdims=True))
            g = (s / s.sum(1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((x[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                mean[i] += 0.1 * (grad - mean[i])
                square[i] += 0.001 * (grad * grad - square[i])
                w[i] -= 0.004 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


class RoutingTree:
    """One model, or a model of models where one can't have parts enough. Leaves are numbered through."""

    def __init__(self, root: LearnedPartition, children: dict[int, LearnedPartition] | None = None):
        self.root, self.children = root, children or {}
        sizes = [self.children[p].parts if p in self.children else 1 for p in range(root.parts)]
        self.first = np.r_[0, np.cumsum(sizes)]
        self.load = np.concatenate([root.load[p] * (self.children[p].load if p in self.children else np.ones(1)) for p in range(root.parts)])

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable leaves of each vector, best first."""
        if not self.children:
            return self.root.route(x, probes)
        wide = self.root.route(x, max(2, (probes + 1) // 2))
        top = _log_softmax(self.root.scores(x))
        leaf, score = [], []
        for rank in range(wide.shape[1]):
            leaves, scores = np.full((len(x), probes), -1, np.int32), np.full((len(x), probes), -np.inf, np.float32)
            for p in np.unique(wide[:, rank]):
                rows, child = np.flatnonzero(wide[:, rank] == p), self.children.get(int(p))
                if child is None or child.weights is None:
                    leaves[rows, 0], scores[rows, 0] = self.first[p], top[rows, p]
                    continue
                own = child.route(x[rows], probes)
                s = np.take_along_axis(_log_softmax(child.scores(x[rows])), own, 1)
                leaves[rows, : own.shape[1]], scores[rows, : own.shape[1]] = self.first[p] + own, s + top[rows, p][:, None]
            leaf.append(leaves)
            score.append(scores)
        leaf_, order = np.concatenate(leaf, 1), np.argsort(-np.concatenate(score, 1), axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(leaf_, order, 1)


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))
