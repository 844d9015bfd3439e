"""Sequential kernels on one connected problem: contraction, agglomeration, multicut, watershed, min-cut.

They take plain lists of edges (u, v, w) and return {node: label}, where a label is the
smallest node of its cluster. Ties are broken by the smallest edge, so results do not
depend on the order of rows. `solve.py` runs them for every component in parallel.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict, deque
from collections.abc import Callable, Iterable

Edges = list[tuple[int, int, float]]
Labels = dict[int, int]


class Sets:
    """Union-find whose representative is the smallest member."""

    def __init__(self, items: Iterable[int] = ()):
        self.parent = {x: x for x in items}

    def find(self, x: int) -> int:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: int, b: int) -> tuple[int, int]:
        """(alive, dead) root."""
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a
        return a, b

    def labels(self) -> Labels:
        return {x: self.find(x) for x in sorted(self.parent)}


def nodes_of(edges: Edges) -> list[int]:
    return sorted({x for u, v, _ in edges for x in (u, v)})


class Contraction:
    """A graph whose edges are contracted; parallel edges are merged by a rule on their data."""

    def __init__(self, edges: Iterable[tuple[int, int, object]], merge: Callable):
        self.near: dict[int, dict[int, object]] = defaultdict(dict)
        self.sets, self.merge = Sets(), merge
        for u, v, data in edges:
            self.sets.find(u), self.sets.find(v)
            if u != v:
                old = self.near[u].get(v)
                self.near[u][v] = self.near[v][u] = data if old is None else merge(old, data)

    def contract(self, u: int, v: int) -> tuple[int, int, list[int]]:
        """Merge two adjacent roots; (alive, dead, neighbours whose edge changed)."""
        alive, dead = self.sets.union(u, v)
        near, gone = self.near[alive], self.near.pop(dead)
        near.pop(dead, None)
        gone.pop(alive, None)
        for n, data in gone.items():
            del self.near[n][dead]
            near[n] = self.near[n][alive] = self.merge(near[n], data) if n in near else data
        return alive, dead, sorted(gone)


# linkage rules on (value, weight)


def _mean(a, b):
    w = a[1] + b[1]
    return ((a[0] * a[1] + b[0] * b[1]) / w, w)


def _abs_max(a, b):
    if abs(a[0]) == abs(b[0]) and a[0] != b[0]:
        return (-abs(a[0]), a[1] + b[1])
    return (max(a[0], b[0], key=abs), a[1] + b[1])


def power_mean(p: float):
    if math.isinf(p):
        return LINKAGE["max" if p > 0 else "min"]

    def rule(a, b):
        w = a[1] + b[1]
        return (((a[0] ** p * a[1] + b[0] ** p * b[1]) / w) ** (1 / p), w)

    return rule if abs(p - 1) > 1e-9 else _mean


def smooth_max(p: float = 0.0):
    def rule(a, b):
        ea, eb = a[1] * math.exp(p * a[0]), b[1] * math.exp(p * b[0])
        return ((a[0] * ea + b[0] * eb) / (ea + eb), a[1] + b[1])

    return rule


class Ranked(float):
    """A quantile of a histogram, which it carries; merging adds histograms."""

    counts: tuple[float, ...]

    @classmethod
    def of(cls, counts: tuple[float, ...], q: float, low: float, high: float) -> Ranked:
        bins = len(counts)
        goal, cum, value = q * sum(counts), 0.0, high
        for b, n in enumerate(counts):
            if n > 0 and cum <= goal <= cum + n:
                value = low if b == 0 else low + (high - low) * (b - 1 + (high - low) / bins / 2 + (goal - cum) / n) / (bins - 1)
                break
            cum += n
        out = cls(value)
        out.counts = counts
        return out

    @classmethod
    def single(cls, w: float, weight: float, q: float, bins: int, low: float, high: float) -> Ranked:
        at = (w - low) / (high - low) * (bins - 1) if high > low else 0.0
        b = int(at)
        counts = [0.0] * bins
        counts[b] += weight * (1 - (at - b))
        if at > b:
            counts[b + 1] += weight * (at - b)
        return cls.of(tuple(counts), q, low, high)


LINKAGE = {
    "mean": _mean,
    "sum": lambda a, b: (a[0] + b[0], a[1] + b[1]),
    "max": lambda a, b: (max(a[0], b[0]), a[1] + b[1]),
    "min": lambda a, b: (min(a[0], b[0]), a[1] + b[1]),
    "abs_max": _abs_max,
}
_ALIASES = {"average": "mean", "avg": "mean", "single_linkage": "max", "complete_linkage": "min", "mutex_watershed": "abs_max"}


def linkage(name: str, **kwargs) -> Callable:
    """A rule by name; an unknown name raises."""
    name = _ALIASES.get(name, name)
    if name in LINKAGE:
        return LINKAGE[name]
    if name in ("generalized_mean", "gmean"):
        return power_mean(kwargs.get("p", 1.0))
    if name in ("smooth_max", "smax"):
        return smooth_max(kwargs.get("p", 0.0))
    raise NotImplementedError(f"no linkage {name!r}")


def _run(graph: Contraction, priority: Callable, stop: Callable, smallest: bool, merged: Callable | None = None) -> list[tuple[int, int, float]]:
    """Contract the best edge again and again; (alive, dead, priority) of every merge."""
    sign = 1 if smallest else -1
    heap, stamp = [], {}

    def push(u: int, v: int) -> None:
        u, v = min(u, v), max(u, v)
        p = priority(u, v, graph.near[u][v])
        if p is not None:
            stamp[u, v] = p
            heapq.heappush(heap, (sign * p, u, v))

    for u in sorted(graph.near):
        for v in sorted(graph.near[u]):
            if u < v:
                push(u, v)
    out: list[tuple[int, int, float]] = []
    while heap:
        p, u, v = heapq.heappop(heap)
        if v not in graph.near.get(u, ()) or stamp.get((u, v)) != sign * p:
            continue
        if stop(sign * p, len(out)):
            break
        alive, dead, _ = graph.contract(u, v)
        if merged:
            merged(alive, dead)
        out.append((alive, dead, sign * p))
        for n in sorted(graph.near[alive]):
            push(alive, n)
    return out


def _finish(graph: Contraction, nodes: Iterable[int]) -> Labels:
    for x in nodes:
        graph.sets.find(x)
    return graph.sets.labels()


def size_factor(a: float, b: float, r: float) -> float:
    """Twice the harmonic term of two sizes to the power r."""
    return 2.0 / (1.0 / a**r + 1.0 / b**r)


def edge_weighted_clustering(edges: Edges, sizes: dict[int, float] | None = None, edge_sizes: list[float] | None = None, regularizer: float = 0.5, stop_nodes: int = 1, dendrogram: list | None = None) -> Labels:
    """Least size-regularised mean indicator first, until stop_nodes are left."""
    nodes = nodes_of(edges)
    size = {x: 1.0 for x in nodes} | (sizes or {})
    g = Contraction([(u, v, (w, 1.0 if edge_sizes is None else edge_sizes[k])) for k, (u, v, w) in enumerate(edges)], _mean)

    def merged(a: int, d: int) -> None:
        size[a] += size[d]

    steps = _run(g, lambda u, v, x: x[0] * size_factor(size[u], size[v], regularizer), lambda p, n: len(nodes) - n <= stop_nodes, True, merged)
    if dendrogram is not None:
        dendrogram.extend(steps)
    return _finish(g, nodes)


def node_edge_clustering(edges: Edges, features: dict[int, list[float]], beta: float = 0.5, regularizer: float = 0.5, stop_nodes: int = 1) -> Labels:
    """Blend of edge indicator and distance of (size-weighted mean) node features."""
    nodes = nodes_of(edges)
    size = {x: 1.0 for x in nodes}
    f = {x: list(features[x]) for x in nodes}
    g = Contraction([(u, v, (w, 1.0)) for u, v, w in edges], _mean)

    def merged(a: int, d: int) -> None:
        f[a] = [(x * size[a] + y * size[d]) / (size[a] + size[d]) for x, y in zip(f[a], f[d], strict=True)]
        size[a] += size[d]

    p = lambda u, v, x: (beta * math.dist(f[u], f[v]) + (1 - beta) * x[0]) * size_factor(size[u], size[v], regularizer)
    _run(g, p, lambda p, n: len(nodes) - n <= stop_nodes, True, merged)
    return _finish(g, nodes)


def size_limit_clustering(edges: Edges, sizes: dict[int, float], minimum: float, gamma: float = 1.0, regularizer: float = 0.001) -> Labels:
    """Merge while a node is below the minimum size; edges with one small end cost gamma more."""
    nodes = nodes_of(edges)
    size = {x: float(sizes.get(x, 1)) for x in nodes}
    g = Contraction([(u, v, (w, 1.0)) for u, v, w in edges], _mean)

    def merged(a: int, d: int) -> None:
        size[a] += size[d]

    def p(u: int, v: int, x) -> float | None:
        small = (size[u] < minimum) + (size[v] < minimum)
        return None if not small else x[0] * (1 if small == 2 else gamma) * size_factor(size[u], size[v], regularizer)

    _run(g, p, lambda p, n: False, True, merged)
    return _finish(g, nodes)


def mala_clustering(edges: Edges, threshold: float = 0.5, bins: int = 40) -> Labels:
    """Priority is the median of a histogram an edge; histograms add; stops at the threshold."""
    nodes = nodes_of(edges)

    def hist(w: float) -> tuple[float, ...]:
        b = min(max(w, 0.0), 1.0) * (bins - 1)
        lo = math.floor(b)
        h = [0.0] * bins
        h[lo] += 1 - (b - lo)
        if b > lo:
            h[lo + 1] += b - lo
        return tuple(h)

    def median(h: tuple[float, ...]) -> float:
        goal, cum = sum(h) / 2, 0.0
        for b, n in enumerate(h):
            if n > 0 and cum <= goal <= cum + n:
                return 0.0 if b == 0 else (b - 1 + 0.5 / bins + (goal - cum) / n) / (bins - 1)
            cum += n
        return 1.0

    g = Contraction([(u, v, hist(w)) for u, v, w in edges], lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
    _run(g, lambda u, v, h: median(h), lambda p, n: p >= threshold, True)
    return _finish(g, nodes)


def lifted_clustering(edges: Edges, lifted: Edges, regularizer: float = 0.5, stop_nodes: int = 1) -> Labels:
    """As edge-weighted clustering; a lifted edge can only be taken after it was merged with a local one."""
    nodes = nodes_of(edges + lifted)
    size = {x: 1.0 for x in nodes}
    rule = lambda a, b: (*_mean(a, b), a[2] or b[2])
    g = Contraction([(u, v, (w, 1.0, True)) for u, v, w in edges] + [(u, v, (w, 1.0, False)) for u, v, w in lifted], rule)

    def merged(a: int, d: int) -> None:
        size[a] += size[d]

    _run(g, lambda u, v, x: x[0] * size_factor(size[u], size[v], regularizer) if x[2] else None, lambda p, n: len(nodes) - n <= stop_nodes, True, merged)
    return _finish(g, nodes)


def gasp(edges: Edges, criteria: str = "mean", constraints: bool = False, lifted: Edges = (), regularizer: float = 0.0, stop_nodes: int = 1, edge_sizes: list[float] | None = None, **kwargs) -> Labels:
    """Signed agglomeration: the most attractive pair merges; with constraints, the most decided pair merges or is barred."""
    nodes = nodes_of(list(edges) + list(lifted))
    ranked = criteria in ("rank", "quantile", "rank_order")
    if ranked:
        q, bins = kwargs.get("q", 0.5), kwargs.get("bins", 40)
        every = [w for _, _, w in [*edges, *lifted]] or [0.0]
        low, high = min(every), max(every)
        rule = lambda a, b: (Ranked.of(tuple(x + y for x, y in zip(a[0].counts, b[0].counts, strict=True)), q, low, high), a[1] + b[1])
    else:
        rule = linkage(criteria, **kwargs)
    size = {x: 1.0 for x in nodes}
    barred: dict[int, set[int]] = defaultdict(set)
    weight = lambda k: 1.0 if edge_sizes is None else edge_sizes[k]
    scale = lambda k, w: w * weight(k) if criteria == "sum" else w
    if ranked:
        scale = lambda k, w: Ranked.single(w, weight(k), q, bins, low, high)
    far = lambda w: Ranked.single(w, 1.0, q, bins, low, high) if ranked else w
    start = [(u, v, (scale(k, w), weight(k), True)) for k, (u, v, w) in enumerate(edges)] + [(u, v, (far(w), 1.0, False)) for u, v, w in lifted]
    g = Contraction(start, lambda a, b: (*rule(a[:2], b[:2]), a[2] or b[2]))

    def priority(u: int, v: int, x) -> float | None:
        if v in barred[u] or not x[2] and not (constraints and x[0] <= 0):
            return None
        p = abs(x[0]) if constraints else x[0]
        return p / size_factor(size[u], size[v], regularizer) if regularizer else p

    heap: list[tuple[float, int, int]] = []
    stamp: dict[tuple[int, int], float] = {}

    def push(u: int, v: int) -> None:
        u, v = min(u, v), max(u, v)
        p = priority(u, v, g.near[u][v])
        stamp.pop((u, v), None)
        if p is not None:
            stamp[u, v] = p
            heapq.heappush(heap, (-p, u, v))

    for u in sorted(g.near):
        for v in sorted(g.near[u]):
            if u < v:
                push(u, v)
    left = len(nodes)
    while heap and left > stop_nodes:
        p, u, v = heapq.heappop(heap)
        if v not in g.near.get(u, ()) or stamp.get((u, v)) != -p:
            continue
        value = g.near[u][v][0]
        if value <= 0:
            if not constraints:
                break
            barred[u].add(v)
            barred[v].add(u)
            continue
        alive, dead, _ = g.contract(u, v)
        left -= 1
        size[alive] += size[dead]
        for n in barred.pop(dead, set()):
            barred[n].discard(dead)
            barred[n].add(alive)
            barred[alive].add(n)
        for n in sorted(g.near[alive]):
            push(alive, n)
    return _finish(g, nodes)


def dual_clustering(merge: Edges, split: Edges, stop: float = 0.5) -> Labels:
    """Priority is the mean of a merge signal and one less a split signal, both averaged over parallel edges."""
    nodes = nodes_of(merge)
    other = {(min(u, v), max(u, v)): w for u, v, w in split}
    rule = lambda a, b: (*_mean(a[:2], b[:2]), *_mean(a[2:], b[2:]))
    g = Contraction([(u, v, (w, 1.0, other.get((min(u, v), max(u, v)), 0.0), 1.0)) for u, v, w in merge], rule)
    _run(g, lambda u, v, x: (x[0] + 1 - x[2]) / 2, lambda p, n: p <= stop, False)
    return _finish(g, nodes)


def ucm(edges: Edges, regularizers: Iterable[float], pairs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, list[float]]]:
    """For each edge (or given pair) and regulariser, the priority at which its ends merged."""
    pairs = [(u, v) for u, v, _ in edges] if pairs is None else pairs
    out = {p: [] for p in pairs}
    for r in regularizers:
        steps: list[tuple[int, int, float]] = []
        edge_weighted_clustering(edges, regularizer=r, dendrogram=steps)
        tree: dict[int, tuple[int, float, int]] = {d: (a, p, t) for t, (a, d, p) in enumerate(steps)}
        for u, v in pairs:
            a, b, height = u, v, 0.0
            while a != b:
                ta = tree[a][2] if a in tree else math.inf
                tb = tree[b][2] if b in tree else math.inf
                if ta <= tb:
                    a, height = tree[a][0], tree[a][1]
                else:
                    b, height = tree[b][0], tree[b][1]
            out[u, v].append(height)
    return [(u, v, h) for (u, v), h in out.items()]


# multicut


def energy(edges: Edges, labels: Labels) -> float:
    return sum(w for u, v, w in edges if labels[u] != labels[v])


def canonical(labels: dict[int, int]) -> Labels:
    low: dict[int, int] = {}
    for x in sorted(labels):
        low.setdefault(labels[x], x)
    return {x: low[y] for x, y in labels.items()}


def connected(edges: Edges, labels: Labels) -> Labels:
    """Labels split into connected parts."""
    s = Sets(labels)
    for u, v, _ in edges:
        if labels[u] == labels[v]:
            s.union(u, v)
    return s.labels()


def greedy_additive(edges: Edges, stop_weight: float = 0.0, stop_nodes: int = -1) -> Labels:
    nodes = nodes_of(edges)
    g = Contraction(edges, lambda a, b: a + b)
    goal = stop_nodes * len(nodes) if 0 < stop_nodes < 1 else stop_nodes
    _run(g, lambda u, v, w: w, lambda p, n: p <= stop_weight or len(nodes) - n <= goal, False)
    return _finish(g, nodes)


def greedy_fixation(edges: Edges) -> Labels:
    return gasp(edges, "sum", constraints=True)


def kernighan_lin(edges: Edges, labels: Labels | None = None, outer: int = 100, eps: float = 1e-6) -> Labels:
    """Moves border nodes between pairs of clusters, joins pairs, and splits clusters, while the energy falls."""
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for u, v, w in edges:
        near[u][v] = near[v][u] = near[u].get(v, 0.0) + w
    labels = dict(labels) if labels else greedy_additive(edges)
    labels = canonical(connected(edges, labels))

    def improve(a: list[int], b: list[int]) -> tuple[float, list[int], list[int]]:
        """Best prefix of moves between two sets, or their union: (gain, new a, new b)."""
        side = dict.fromkeys(a, 0) | dict.fromkeys(b, 1)
        d = {x: sum(w * (1 if side[y] != side[x] else -1) for y, w in near[x].items() if y in side) for x in side}
        cut = sum(w for x in a for y, w in near[x].items() if side.get(y) == 1)
        start, total, best, path, free = dict(side), 0.0, (0.0, 0), [], set(side)
        while free:
            border = [x for x in free if not b or any(side.get(y, side[x]) != side[x] for y in near[x])]
            if not border:
                break
            x = max(border, key=lambda x: (d[x], -x))
            total += d[x]
            free.discard(x)
            side[x] = 1 - side[x]
            d[x] = -d[x]
            path.append(x)
            for y, w in near[x].items():
                if y in side:
                    d[y] += 2 * w if side[y] != side[x] else -2 * w
            if total > best[0] + eps:
                best = (total, len(path))
        if a and b and cut > best[0] + eps:
            return cut, sorted([*a, *b]), []
        if best[1] == 0:
            return 0.0, a, b
        for x in path[: best[1]]:
            start[x] = 1 - start[x]
        return best[0], sorted(x for x in start if start[x] == 0), sorted(x for x in start if start[x] == 1)

    for _ in range(outer):
        gain = 0.0
        clusters: dict[int, list[int]] = defaultdict(list)
        for x in sorted(labels):
            clusters[labels[x]].append(x)
        pairs = sorted({tuple(sorted((labels[u], labels[v]))) for u, v, _ in edges if labels[u] != labels[v]})
        for p, q in pairs:
            if clusters[p] and clusters[q]:
                g, clusters[p], clusters[q] = improve(clusters[p], clusters[q])
                gain += g
        fresh = max(clusters, default=0) + 1
        for p in sorted(clusters):
            if len(clusters[p]) > 1:
                g, clusters[p], new = improve(clusters[p], [])
                gain += g
                if new:
                    clusters[fresh] = new
                    fresh += 1
        labels = {x: p for p, members in clusters.items() for x in members}
        new_labels = canonical(connected(edges, labels))
        labels = new_labels
        if gain <= eps:
            break
    return labels


def fuse(edges: Edges, proposals: list[Labels], solver: Callable[[Edges], Labels] = kernighan_lin) -> Labels:
    """Contract what all proposals join, solve the rest, and keep the best of all."""
    nodes = nodes_of(edges)
    s = Sets(nodes)
    for u, v, _ in edges:
        if all(p[u] == p[v] for p in proposals):
            s.union(u, v)
    small: dict[tuple[int, int], float] = defaultdict(float)
    for u, v, w in edges:
        a, b = sorted((s.find(u), s.find(v)))
        if a != b:
            small[a, b] += w
    best = min(proposals, key=lambda p: energy(edges, p))
    if not small:
        return best
    solved = solver([(a, b, w) for (a, b), w in sorted(small.items())])
    out = canonical({x: solved.get(s.find(x), s.find(x)) for x in nodes})
    return out if energy(edges, out) <= energy(edges, best) else best


def watershed_proposal(edges: Edges, sigma: float, seeds: float, rng: random.Random) -> Labels:
    noisy = [(u, v, w + rng.gauss(0, sigma)) for u, v, w in edges]
    nodes = nodes_of(edges)
    n = int(len(nodes) * seeds + 0.5) if seeds <= 1 else int(seeds)
    negative = [(u, v) for u, v, w in edges if w < 0]
    seed: dict[int, int] = {}
    for k in range(max(1, n // 2)):
        if negative:
            u, v = rng.choice(negative)
            seed[u], seed[v] = 2 * k + 1, 2 * k + 2
    if not seed:
        return dict.fromkeys(nodes, nodes[0])
    return canonical(kruskal_watershed([(u, v, -w) for u, v, w in noisy], seed))


def fusion_moves(edges: Edges, rounds: int = 20, patience: int = 5, sigma: float = 1.0, seeds: float = 0.1, seed: int = 0) -> Labels:
    """Fuses the best solution with one watershed proposal after another."""
    rng = random.Random(seed)
    best, idle = greedy_additive(edges), 0
    for _ in range(rounds):
        new = fuse(edges, [best, watershed_proposal(edges, sigma, seeds, rng)])
        idle = 0 if energy(edges, new) < energy(edges, best) - 1e-9 else idle + 1
        best = new
        if idle >= patience:
            break
    return canonical(connected(edges, best))


def chained(*solvers: Callable) -> Callable:
    """A solver that hands each one's labels to the next."""

    def run(edges: Edges) -> Labels:
        labels = solvers[0](edges)
        for s in solvers[1:]:
            labels = s(edges, labels)
        return labels

    return run


def exact_multicut(edges: Edges) -> Labels:
    """The best of all partitions; for at most 10 nodes."""
    nodes = nodes_of(edges)
    if len(nodes) > 10:
        raise ValueError("at most 10 nodes")
    best = (math.inf, {})

    def grow(k: int, labels: Labels, used: int) -> None:
        nonlocal best
        if k == len(nodes):
            e = energy(edges, labels)
            if e < best[0] - 1e-12:
                best = (e, dict(labels))
            return
        for c in range(used + 1):
            labels[nodes[k]] = c
            grow(k + 1, labels, max(used, c + 1))

    grow(0, {}, 0)
    return canonical(best[1])


def two_way_cut(edges: Edges, rounds: int = 50, seed: int = 0) -> Labels:
    """Two labels of low energy: a walk that decides the heaviest edges first, then flips single nodes while that helps."""
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    side: Labels = {}
    parent, parity = {x: x for x in near}, dict.fromkeys(near, 0)

    def find(x: int) -> tuple[int, int]:
        p = 0
        while parent[x] != x:
            p ^= parity[x]
            x = parent[x]
        return x, p

    for u, v, w in sorted(edges, key=lambda e: (-abs(e[2]), e[:2])):
        (a, p), (b, q) = find(u), find(v)
        if a != b:
            parent[b], parity[b] = a, p ^ q ^ int(w < 0)
    for x in sorted(near):
        side[x] = find(x)[1]
    for _ in range(rounds):
        moved = False
        for x in sorted(near):
            if sum(w if side[y] != side[x] else -w for y, w in near[x]) > 1e-12:
                side[x] = 1 - side[x]
                moved = True
        if not moved:
            break
    return side


def perturb(edges: Edges, kind: str, magnitude: float, seed: int) -> Edges:
    rng = random.Random(seed)
    noise = {
        "uniform": lambda w: w + (rng.random() - 0.5) * 2 * magnitude,
        "normal": lambda w: w + rng.gauss(0, 1) * magnitude,
        "less_certain": lambda w: w - math.copysign(abs(w) * rng.random() * magnitude, w),
    }[kind]
    return [(u, v, noise(w)) for u, v, w in edges]


def lifted_greedy_additive(edges: Edges, lifted: Edges) -> Labels:
    """Merges the most attractive pair that shares a local edge; lifted costs move with it."""
    nodes = nodes_of(edges + lifted)
    g = Contraction([(u, v, (w, True)) for u, v, w in edges] + [(u, v, (w, False)) for u, v, w in lifted], lambda a, b: (a[0] + b[0], a[1] or b[1]))
    _run(g, lambda u, v, x: x[0] if x[1] else None, lambda p, n: p <= 0, False)
    return _finish(g, nodes)


def lifted_kernighan_lin(edges: Edges, lifted: Edges, labels: Labels | None = None) -> Labels:
    """Moves on the lifted objective; clusters are split into parts connected by local edges, while that does not raise the energy."""
    total = edges + lifted
    labels = labels or lifted_greedy_additive(edges, lifted)
    new = canonical(connected(edges, kernighan_lin(total, labels)))
    return new if energy(total, new) < energy(total, labels) else canonical(labels)


def lifted_fusion_moves(edges: Edges, lifted: Edges, rounds: int = 10, seed: int = 0) -> Labels:
    rng = random.Random(seed)
    total = edges + lifted
    best = lifted_greedy_additive(edges, lifted)
    for k in range(rounds):
        base = (edges, lifted or edges, total)[k % 3]
        prop = watershed_proposal(base, 1.0, 0.1, rng)
        prop = {x: prop.get(x, x) for x in nodes_of(total)}
        new = canonical(connected(edges, fuse(total, [best, prop])))
        if energy(total, new) < energy(total, best):
            best = new
    return canonical(best)


# watersheds, carving, min-cut


def kruskal_watershed(edges: Edges, seeds: dict[int, int]) -> dict[int, int]:
    """Seeds grow over the lightest edges first; components without a seed keep 0."""
    s = Sets(nodes_of(edges))
    label = {x: seeds.get(x, 0) for x in s.parent}
    for _, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges):
        a, b = s.find(u), s.find(v)
        if a != b and (not label[a] or not label[b]):
            new = max(label[a], label[b])
            label[s.union(a, b)[0]] = new
    return {x: label[s.find(x)] for x in s.labels()}


def prim_watershed(edges: Edges, seeds: dict[int, int], cost: Callable | None = None, largest: bool = False) -> dict[int, int]:
    """Seeds grow by a priority queue of the edges they reach."""
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    label = {x: seeds.get(x, 0) for x in nodes_of(edges)}
    heap: list[tuple[float, int, int, int]] = []
    tick = 0

    def push(x: int) -> None:
        nonlocal tick
        for y, w in sorted(near[x]):
            if not label[y]:
                c = cost(label[x], w) if cost else w
                heapq.heappush(heap, (-c if largest else c, tick, x, y))
                tick += 1

    for x in sorted(label):
        if label[x]:
            push(x)
    while heap:
        _, _, x, y = heapq.heappop(heap)
        if not label[y]:
            label[y] = label[x]
            push(y)
    return label


def node_watershed(edges: Edges, seeds: dict[int, int], heights: dict[int, float]) -> dict[int, int]:
    """Seeds grow to the lowest node they reach."""
    near: dict[int, list[int]] = defaultdict(list)
    for u, v, _ in edges:
        near[u].append(v)
        near[v].append(u)
    label = {x: seeds.get(x, 0) for x in nodes_of(edges)}
    heap: list[tuple[float, int, int, int]] = []
    tick = 0

    def push(x: int) -> None:
        nonlocal tick
        for y in sorted(near[x]):
            if not label[y]:
                heapq.heappush(heap, (heights[y], tick, y, label[x]))
                tick += 1

    for x in sorted(label):
        if label[x]:
            push(x)
    while heap:
        _, _, y, lab = heapq.heappop(heap)
        if not label[y]:
            label[y] = lab
            push(y)
    return label


def carve(edges: Edges, seeds: dict[int, int], bias: float = 1.0, no_bias_below: float = 0.0, background: int = 1) -> dict[int, int]:
    """Two seeds grow; the background's edges of at least no_bias_below are scaled by the bias."""
    return prim_watershed(edges, seeds, lambda lab, w: w * bias if lab == background and w >= no_bias_below else w)


def min_st_cut(edges: Edges, unaries: dict[int, tuple[float, float]]) -> tuple[float, Labels]:
    """(cut value, 0/1 labels) of least pairwise cost (w >= 0) and unary cost (c0, c1); Dinic's algorithm."""
    index = {x: k for k, x in enumerate(sorted(set(nodes_of(edges)) | set(unaries)))}
    n = len(index)
    s, t = n, n + 1
    head: list[list[list]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, c: float, back: float = 0.0) -> None:
        head[a].append([b, c, len(head[b])])
        head[b].append([a, back, len(head[a]) - 1])

    for x, (c0, c1) in unaries.items():
        low = min(c0, c1)
        arc(s, index[x], c1 - low)
        arc(index[x], t, c0 - low)
    base = sum(min(c) for c in unaries.values())
    for u, v, w in edges:
        if w < 0:
            raise ValueError("weights must not be negative")
        arc(index[u], index[v], w, w)
    flow = 0.0
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, c, _ in head[a]:
                if c > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            break
        at = [0] * (n + 2)
        while True:
            path, a = [], s
            while a != t:
                while at[a] < len(head[a]) and not (head[a][at[a]][1] > 1e-12 and level[head[a][at[a]][0]] == level[a] + 1):
                    at[a] += 1
                if at[a] == len(head[a]):
                    if not path:
                        break
                    a = path.pop()
                    at[a] += 1
                else:
                    path.append(a)
                    a = head[a][at[a]][0]
            if a != t:
                break
            push = min(head[x][at[x]][1] for x in path)
            for x in path:
                e = head[x][at[x]]
                e[1] -= push
                head[e[0]][e[2]][1] += push
            flow += push
    # a node that the source still reaches is on its side, label 0
    return flow + base, {x: 0 if level[k] >= 0 else 1 for x, k in index.items()}
