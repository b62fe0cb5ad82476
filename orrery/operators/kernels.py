"""Dense numpy kernels for one slice of a few hundred nodes. They are called by grouped-map operators;
an all-pairs or eigenvalue problem has no declarative form."""

from __future__ import annotations

import heapq

import numpy as np


def pairwise(p: np.ndarray) -> np.ndarray:
    s = (p * p).sum(1)
    d = np.sqrt(np.maximum(s[:, None] + s[None] - 2 * p @ p.T, 0))
    np.fill_diagonal(d, 0)
    return d


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, ties by position."""
    n = len(d)
    shown = d + np.where(np.eye(n, dtype=bool), np.inf, 0)
    return np.argsort(shown, axis=1, kind="stable")[:, : min(k, n - 1)]


def knn_adjacency(d: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrix of edge lengths, inf where there is no edge."""
    n = len(d)
    near = nearest(d, k)
    w = np.full((n, n), np.inf)
    rows = np.repeat(np.arange(n), near.shape[1])
    w[rows, near.ravel()] = d[rows, near.ravel()]
    w = np.minimum(w, w.T)
    np.fill_diagonal(w, 0)
    return w


def labels_of(adjacent: np.ndarray) -> np.ndarray:
    """Component of each node: its least member."""
    label = np.arange(len(adjacent))
    while True:
        least = np.where(adjacent, label[None], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def connect(w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Add the shortest edge between two components until there is one."""
    w = w.copy()
    while True:
        label = labels_of(np.isfinite(w))
        apart = label[:, None] != label[None]
        if not apart.any():
            return w
        i, j = np.unravel_index(np.argmin(np.where(apart, d, np.inf)), d.shape)
        w[i, j] = w[j, i] = d[i, j]


def shortest_paths(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All-pairs distances and predecessors, ties to the least predecessor; -9999 where there is none."""
    n = len(w)
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[None, k], out=d)
    before = np.full((n, n), -9999)
    # arcs by end and then by start: the first that fits is the least predecessor
    y, x = np.nonzero((np.isfinite(w) & ~np.eye(n, dtype=bool)).T)
    length = w[x, y]
    for i in range(n):
        fits = np.isclose(d[i, x] + length, d[i, y], rtol=1e-12, atol=1e-12) & np.isfinite(d[i, y])
        to, at = y[fits], x[fits]
        first = np.r_[True, to[1:] != to[:-1]][: len(to)]
        before[i, to[first]] = at[first]
        before[i, i] = -9999
    return d, before


def path(before: np.ndarray, a: int, b: int) -> list[int]:
    """Nodes from a to b; just the two where the walk breaks off."""
    out, at = [b], b
    while at != a:
        at = int(before[a, at])
        if at < 0 or len(out) > len(before):
            return [a, b]
        out.append(at)
    return out[::-1]


def scattered(x: np.ndarray, *tags: int) -> np.ndarray:
    """Hashes of whole numbers and tags, as draws that any run repeats."""
    h = np.asarray(x).astype(np.uint64)
    for t in (*tags, 0):
        h = (h ^ (h >> np.uint64(31)) ^ np.uint64(t)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def without(w: np.ndarray, gone: np.ndarray) -> np.ndarray:
    w = w.copy()
    w[gone, :] = np.inf
    w[:, gone] = np.inf
    return w


def triangle_defects(g: np.ndarray, u: np.ndarray, v: np.ndarray, ks=(8, 16, 24), draw: np.random.Generator | None = None) -> dict[str, np.ndarray]:
    """Relative excess, at least 0, of the way over a third node, for the k thirds of the shortest such
    way, or k drawn ones: median, 90 % point and share of 0.05 or less, means over the k; the mean
    distance from median to 90 % point, and the 90 % point's growth from the first k to the last."""
    return way_defects(g[u], g[v], g[u, v], u, v, ks, draw)


def way_defects(from_u: np.ndarray, from_v: np.ndarray, length: np.ndarray, u: np.ndarray, v: np.ndarray, ks=(8, 16, 24), draw: np.random.Generator | None = None) -> dict[str, np.ndarray]:
    """triangle_defects() of edges whose ends' distances to all nodes are rows of from_u and from_v."""
    base = np.maximum(length, 1e-8)[:, None]
    ways = from_u + from_v
    at = np.arange(len(u))
    ways[at, u] = ways[at, v] = np.inf
    n, most = ways.shape[1], max(ks)
    if draw is None and most < n:
        ways = np.partition(ways, most, axis=1)[:, : most + 1]
    ways = np.sort(ways, axis=1)
    med, tail, close = [], [], []
    for k in ks:
        some = ways[:, : max(1, min(k, n - 2))]
        if draw is not None:
            some = np.take_along_axis(ways, np.argsort(draw.random((len(u), n - 2)), axis=1)[:, : some.shape[1]], axis=1)
        excess = np.maximum((some - base) / base, 0)
        med.append(np.quantile(excess, 0.5, axis=1))
        tail.append(np.quantile(excess, 0.9, axis=1))
        close.append((excess <= 0.05).mean(axis=1))
    none = (u == v) | (n < 3)
    med, tail, close = (np.where(none, 0.0, np.array(x)) for x in (med, tail, close))
    return {
        "defect_median": med.mean(0), "defect_tail": tail.mean(0), "defect_close": close.mean(0),
        "defect_dispersion": (tail - med).mean(0), "defect_span": tail[-1] - tail[0],
    }


class Links:
    """Undirected edges (u, v, w) of n nodes for shortest paths from some of them at a time, in memory of the
    edges and of nodes times sources."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        a, b, w = np.r_[u, v], np.r_[v, u], np.r_[w, w].astype(float)
        self.n = n
        order = np.lexsort((b, a))
        self.to, self.length = b[order], w[order]
        self.start = np.searchsorted(a[order], np.arange(n + 1))
        # nodes by falling degree: the j-th edges are those of the first nodes
        degree = np.diff(self.start)
        by = np.argsort(-degree, kind="stable")
        self.place = np.empty(n, int)
        self.place[by] = np.arange(n)
        self.nth = []
        for j in range(int(degree.max(initial=0))):
            at = self.start[by[: int((degree > j).sum())]] + j
            self.nth.append((self.place[self.to[at]], self.length[at][:, None]))

    def distances(self, sources: np.ndarray, width: int = 64) -> np.ndarray:
        """A row of distances to all nodes for each source, inf where there is no path."""
        out = np.empty((len(sources), self.n))
        for low in range(0, len(sources), width):
            some = sources[low : low + width]
            d = np.full((self.n, len(some)), np.inf)
            d[self.place[some], np.arange(len(some))] = 0.0
            before = None
            while before is None or not np.array_equal(before, d):
                before = d.copy()
                for to, length in self.nth:
                    np.minimum(d[: len(to)], d[to] + length, out=d[: len(to)])
            out[low : low + width] = d[self.place].T
        return out

    def way(self, row: np.ndarray, a: int, b: int) -> list[int]:
        """Nodes from a to b, where row has the distances from a; of equal ways the least node before each, as
        shortest_paths() and path() choose."""
        out, at = [b], b
        while at != a:
            here = slice(self.start[at], self.start[at + 1])
            to = self.to[here]
            fits = to[np.isclose(row[to] + self.length[here], row[at], rtol=1e-12, atol=1e-12)]
            if not len(fits) or not np.isfinite(row[at]) or len(out) > self.n:
                return [a, b]
            at = int(fits[0])
            out.append(at)
        return out[::-1]


def z(x: np.ndarray) -> np.ndarray:
    s = np.nanstd(x)
    return np.zeros_like(x) if not np.isfinite(s) or s < 1e-8 else np.nan_to_num((x - np.nanmean(x)) / s)


def base_score(g: np.ndarray, support: np.ndarray, u: np.ndarray, v: np.ndarray, f: dict[str, np.ndarray]) -> np.ndarray:
    """The common baseline of an edge: near, supported from u to v, with a clear direction and flat
    triangles. support[i, j] is directed; f: triangle_defects()."""
    margin = np.abs(support[u, v] - support[v, u])
    return (
        z(-g[u, v]) + 0.75 * z(support[u, v]) + 0.35 * z(margin) + 0.35 * z(-f["defect_median"]) + 0.25 * z(-f["defect_tail"])
        + 0.2 * z(f["defect_close"]) + 0.1 * z(-f["defect_span"]) + 0.1 * z(-f["defect_dispersion"])
    )


def support_score(g: np.ndarray, support: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """An edge's length over its support, its support both ways and its direction's clearness."""
    s = np.clip((support[u, v] + support[v, u]) / 2, 0, 1)
    return z(-g[u, v] / (0.35 + s)) + 0.7 * z(s) + 0.3 * z(np.abs(support[u, v] - support[v, u]))


def ball_deficit(g: np.ndarray, u: np.ndarray, v: np.ndarray, k: int = 8) -> np.ndarray:
    """1 - Jaccard of the balls that reach the k-th neighbour of either end."""
    radius = np.sort(g, axis=1)[:, min(k, len(g) - 1)]
    ball = g <= radius[:, None]
    both, any_ = (ball[u] & ball[v]).sum(1), (ball[u] | ball[v]).sum(1)
    return 1 - both / np.maximum(any_, 1)


def turning(points: np.ndarray) -> tuple[float, float, float, float]:
    """Mean and deviation of the turning angle, mean absolute and mean torsion along a path in 3-d. A
    step without length is at a right angle to all; torsion is asked of three steps that span space
    and is 0 where they lie in a plane."""
    p = points[:, :3]
    if p.shape[1] < 3:
        p = np.pad(p, ((0, 0), (0, 3 - p.shape[1])))
    e = np.diff(p, axis=0)
    if len(e) < 2:
        return 0.0, 0.0, 0.0, 0.0
    length = np.linalg.norm(e, axis=1, keepdims=True)
    e = np.where(length < 1e-10, 0.0, e / np.maximum(length, 1e-10))
    turn = np.arccos(np.clip((e[1:] * e[:-1]).sum(1), -1, 1))
    n = np.cross(e[:-1], e[1:])
    a, b, mid = n[:-1], n[1:], e[1:-1]
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    ok = size >= 1e-10
    if not ok.any():
        return float(turn.mean()), float(turn.std()), 0.0, 0.0
    side = np.sign((np.cross(a, b) * mid).sum(1))[ok]
    torsion = side * np.arccos(np.clip((a * b).sum(1)[ok] / size[ok], -1, 1))
    return float(turn.mean()), float(turn.std()), float(np.abs(torsion).mean()), float(torsion.mean())


def rips_h1(d: np.ndarray) -> np.ndarray:
    """Finite (birth, death) of first homology of the Rips complex on a distance matrix, by reduction of
    the triangles' boundary matrix over two elements; bars of length 0 are left out."""
    n = len(d)
    iu, ju = np.triu_indices(n, 1)
    order = np.lexsort((ju, iu, d[iu, ju]))
    iu, ju = iu[order], ju[order]
    rank = np.full((n, n), -1)
    rank[iu, ju] = rank[ju, iu] = np.arange(len(iu))
    length = d[iu, ju]
    pairs = (_pairs_by_bits if n <= BITS else _pairs_by_sets)(list(zip(iu.tolist(), ju.tolist(), strict=True)), rank, len(iu) - max(n - 1, 0))
    return np.array([(length[low], length[e]) for low, e in pairs if length[e] > length[low] + 1e-12]).reshape(-1, 2)


#: Points up to which a column of the boundary matrix is a whole number, a bit an edge.
BITS = 64


def _pairs_by_bits(edges: list[tuple[int, int]], rank: np.ndarray, open_: int) -> list[tuple[int, int]]:
    """(edge that opens a cycle, edge whose triangle closes it), by rank; open_: how many there are."""
    place, joined = rank.tolist(), [0] * len(rank)
    pivots: dict[int, int] = {}
    out = []
    for e, (a, b) in enumerate(edges):  # triangles by their longest edge
        if not open_:
            break
        thirds, at_a, at_b = joined[a] & joined[b], place[a], place[b]
        while thirds:
            t = (thirds & -thirds).bit_length() - 1
            thirds &= thirds - 1
            column = 1 << e | 1 << at_a[t] | 1 << at_b[t]
            while column:
                low = column.bit_length() - 1
                if (other := pivots.get(low)) is None:
                    pivots[low] = column
                    open_ -= 1
                    out.append((low, e))
                    break
                column ^= other
        joined[a] |= 1 << b
        joined[b] |= 1 << a
    return out


def _pairs_by_sets(edges: list[tuple[int, int]], rank: np.ndarray, open_: int) -> list[tuple[int, int]]:
    """As _pairs_by_bits(), for many points, of whose edges a column holds few."""
    pivots: dict[int, set[int]] = {}
    out = []
    for e, (a, b) in enumerate(edges):
        if not open_:
            break
        thirds = np.flatnonzero((rank[a] >= 0) & (rank[b] >= 0) & (rank[a] < e) & (rank[b] < e))
        for t in thirds.tolist():
            column = {e, int(rank[a, t]), int(rank[b, t])}
            while column:
                low = max(column)
                if low not in pivots:
                    pivots[low] = column
                    open_ -= 1
                    out.append((low, e))
                    break
                column = column ^ pivots[low]
    return out


def betti_1(u: np.ndarray, v: np.ndarray, n: int) -> int:
    adjacent = np.zeros((n, n), bool)
    adjacent[u, v] = adjacent[v, u] = True
    return max(0, len(set(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))) - n + len(np.unique(labels_of(adjacent))))


def zigzag_h1(n: int, first: set, second: set) -> dict[str, float]:
    """Cycles of two graphs on n nodes through their union: ranks of the parts, the union and, since
    cycle spaces of graphs embed, of the intersection; long: cycles that live in both parts."""
    rank = lambda e: betti_1(*np.array(sorted(e) or [(0, 0)]).T, n) if e else 0
    a, b, both, one = rank(first), rank(second), rank(first | second), rank(first & second)
    return {"first": a, "second": b, "union": both, "long": one, "total": float(a + b + both - one)}


def double_edge_swaps(edges: np.ndarray, n: int, uniform: np.ndarray, stratum=None) -> np.ndarray:
    """Swap ends of pairs of edges as the rows of uniform (three numbers in [0, 1)) say, where neither a
    loop nor a double edge comes of it. Degrees stay; with stratum(a, b) the strata of both edges do too."""
    edges = edges.copy()
    held = {(min(a, b), max(a, b)) for a, b in edges.tolist()}
    for x, y, side in uniform:
        i, j = int(x * len(edges)), int(y * len(edges))
        (a, b), (c, d) = edges[i], edges[j]
        if side < 0.5:
            c, d = d, c
        new = [(min(a, d), max(a, d)), (min(c, b), max(c, b))]
        if i == j or a == d or c == b or new[0] == new[1] or new[0] in held or new[1] in held:
            continue
        if stratum is not None and sorted((stratum(a, b), stratum(c, d))) != sorted((stratum(*new[0]), stratum(*new[1]))):
            continue
        held -= {(min(a, b), max(a, b)), (min(c, d), max(c, d))}
        held |= set(new)
        edges[i], edges[j] = (a, d), (c, b)
    return edges


def parts(edges: np.ndarray) -> int:
    """Components of the graph that the edges make of their ends."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges.tolist():
        root[find(a)] = find(b)
    return sum(find(x) == x for x in list(root))


def doubly_stochastic(n: int, draw: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A random positive matrix whose rows and columns have all the same sum, 1 together."""
    m = draw.random((n, n)) + 1e-8
    for _ in range(rounds):
        m = m / np.maximum(m.sum(1, keepdims=True), 1e-12)
        m = m / np.maximum(m.sum(0, keepdims=True), 1e-12)
    return m / max(m.sum(), 1e-12)


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost matching (shortest augmenting paths), rows <= columns."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, via, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            via[1:][better] = at
            free = np.where(used[1:], np.inf, least[1:])
            to = int(free.argmin()) + 1
            delta = free[to - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            at = to
        while at:
            match[at], at = match[via[at]], via[at]
    out = np.empty(n, int)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out


def sinkhorn(cost: np.ndarray, epsilon: float = 0.1, rounds: int = 200) -> np.ndarray:
    """Entropic transport plan with uniform marginals."""
    k = np.maximum(np.exp(-cost / epsilon), 1e-300)
    n, m = k.shape
    a = np.ones(n)
    for _ in range(rounds):
        b = (1 / m) / (k.T @ a)
        a = (1 / n) / (k @ b)
    return a[:, None] * k * b[None]


def gromov_wasserstein(c1: np.ndarray, c2: np.ndarray, plan: np.ndarray | None = None, epsilons=(0.1, 0.05, 0.02), rounds: int = 20) -> tuple[np.ndarray, float]:
    """Entropic Gromov-Wasserstein plan between two distance matrices, annealed from plan, and its loss."""
    n, m = len(c1), len(c2)
    p, q = np.full(n, 1 / n), np.full(m, 1 / m)
    t = np.outer(p, q) if plan is None else plan
    fixed = (c1**2 @ p)[:, None] + (c2**2 @ q)[None]
    for e in epsilons:
        for _ in range(rounds):
            cost = fixed - 2 * c1 @ t @ c2.T
            t = sinkhorn(cost - cost.min(), e * max(np.ptp(cost), 1e-9), 100)
    return t, float(((fixed - 2 * c1 @ t @ c2.T) * t).sum())


def procrustes(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The orthogonal map that takes rows x closest to y."""
    if weights is not None:
        x, y = x * np.sqrt(weights)[:, None], y * np.sqrt(weights)[:, None]
    u, _, vt = np.linalg.svd(x.T @ y)
    return u @ vt


def inverse_root(m: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    lam, vec = np.linalg.eigh((m + m.T) / 2)
    return vec / np.sqrt(np.maximum(lam, floor)) @ vec.T


def spectral(adjacency: np.ndarray, k: int) -> np.ndarray:
    """Eigenvectors 1 to k of the normalised Laplacian, each at deviation 1."""
    deg = adjacency.sum(1)
    r = 1 / np.sqrt(np.maximum(deg, 1e-12))
    lam, vec = np.linalg.eigh(np.eye(len(adjacency)) - r[:, None] * adjacency * r[None])
    v = vec[:, 1 : k + 1]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return (v - v.mean(0)) / np.maximum(v.std(0), 1e-12)


def _neighbours(n: int, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """The other ends of each node's edges, in order."""
    at, to = np.r_[u, v], np.r_[v, u]
    order = np.lexsort((to, at))
    return np.split(to[order], np.cumsum(np.bincount(at, minlength=n))[:-1]) if n else []


def propagated_labels(adjacent: np.ndarray, order: np.ndarray, rounds: int = 20) -> np.ndarray:
    """spread_labels() of a matrix."""
    return spread_labels(len(adjacent), *np.nonzero(np.triu(adjacent, 1)), order, rounds)


def spread_labels(n: int, u: np.ndarray, v: np.ndarray, order: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Majority label of the neighbours, node by node in the given order, ties to the least label."""
    label, near_of = np.arange(n), _neighbours(n, u, v)
    for _ in range(rounds):
        moved = False
        for i in order:
            near = label[near_of[i]]
            if len(near):
                names, many = np.unique(near, return_counts=True)
                new = names[many.argmax()]
                moved |= new != label[i]
                label[i] = new
        if not moved:
            break
    return label


def greedy_modularity(adjacent: np.ndarray) -> np.ndarray:
    """merged_communities() of a matrix."""
    return merged_communities(len(adjacent), *np.nonzero(np.triu(adjacent, 1)))


def merged_communities(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Communities by merging the pair that gains most modularity while any does, ties to the least pair. Each edge
    (u, v) is there once; memory is that of the edges."""
    m = len(u)
    a = (np.bincount(np.r_[u, v].astype(int), minlength=n) / max(2 * m, 1)).tolist()
    e: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        e[i][j] = e[j][i] = 1 / (2 * m)
    into = list(range(n))
    gain = lambda i, j: 2 * (e[i][j] - a[i] * a[j])
    every = lambda: [(-gain(i, j), i, j) for i in range(n) for j in e[i] if i < j]
    heap = every()
    heapq.heapify(heap)
    limit = 4 * len(heap) + 1000
    while heap:
        lost, i, j = heapq.heappop(heap)
        # what was true when it was put in: a merge puts the pairs that it changes in anew
        if into[i] != i or into[j] != j or -lost != gain(i, j):
            continue
        if not -lost > 1e-12:
            break
        for x, share in e[j].items():
            if x != i:
                e[i][x] = e[x][i] = e[i].get(x, 0.0) + share
                del e[x][j]
        del e[i][j]
        e[j] = {}
        a[i] += a[j]
        into[j] = i
        for x in e[i]:
            p, q = min(i, x), max(i, x)
            heapq.heappush(heap, (-gain(p, q), p, q))
        if len(heap) > limit:
            heap = every()
            heapq.heapify(heap)
    label = np.arange(n)
    for j in range(n):
        label[j] = j if into[j] == j else label[into[j]]  # a node goes into a smaller one
    return label


def tree_lengths(p: np.ndarray) -> np.ndarray:
    """Lengths of the edges of a minimum spanning tree of points, grown from the first, in memory of the points."""
    n, q = len(p), np.ascontiguousarray(p.T, float)
    best, out = np.full(n, np.inf), np.empty(max(n - 1, 0))
    left, j = np.ones(n, bool), 0
    for step in range(n - 1):
        left[j] = False
        far = np.zeros(n)
        for x in q:
            gap = x - x[j]
            far += gap * gap
        np.minimum(best, far, out=best, where=left)
        best[j] = np.inf
        j = int(best.argmin())
        out[step] = best[j]
    return np.sqrt(out)


def spectral_gap(n: int, u: np.ndarray, v: np.ndarray, dense: int = 512, width: int = 120, still: float = 1e-9) -> float:
    """The second least eigenvalue of the normalised Laplacian of edges (u, v), each there once. Of more than `dense` nodes
    by Lanczos steps beside the known vector of the least, begun anew from the best one after `width` steps."""
    degree = np.bincount(np.r_[u, v].astype(int), minlength=n)
    r = 1 / np.sqrt(np.maximum(degree, 1e-12))
    if n <= dense:
        a = np.zeros((n, n))
        a[u, v] = a[v, u] = 1.0
        return float(np.sort(np.linalg.eigvalsh(np.eye(n) - r[:, None] * a * r[None]))[1])
    label = np.arange(n)
    while True:  # more than one part: 0 is there again
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    if label.any():
        return 0.0
    at, to = np.r_[u, v], np.r_[v, u]
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    share = r[at] * r[to]
    known = np.sqrt(degree / degree.sum())
    x = np.random.default_rng(7907).standard_normal(n)
    value = 0.0
    for _ in range(50):
        basis = np.empty((width + 1, n))
        basis[0] = known
        x -= known * (known @ x)
        x /= np.linalg.norm(x)
        diagonal, beside, k = [], [], 0
        while k < width:
            k += 1
            basis[k] = x
            y = np.bincount(at, share * x[to], n)
            diagonal.append(x @ y)
            for _ in range(2):
                y -= basis[: k + 1].T @ (basis[: k + 1] @ y)
            size = np.linalg.norm(y)
            beside.append(size)
            if size < 1e-13:
                break
            x = y / size
        t = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
        lam, vec = np.linalg.eigh(t)
        value = lam[-1]
        if beside[-1] * abs(vec[-1, -1]) < still:
            break
        x = basis[1 : k + 1].T @ vec[:, -1]
    return float(1 - value)


def minimum_tree(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning tree, grown from node 0."""
    n, inside, out = len(d), {0}, []
    best, via = d[0].copy(), np.zeros(n, int)
    for _ in range(n - 1):
        best[list(inside)] = np.inf
        j = int(best.argmin())
        out.append((min(int(via[j]), j), max(int(via[j]), j), float(d[via[j], j])))
        inside.add(j)
        closer = d[j] < best
        best[closer], via[closer] = d[j][closer], j
    return out


def logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, rounds: int = 300, balanced: bool = True) -> np.ndarray:
    """Coefficients, intercept last and not penalised, by accelerated proximal steps on standardised
    columns, which start anew where they turn back and end where they stand still. l1 and l2 are
    per-row penalties."""
    mu, sd = x.mean(0), np.maximum(x.std(0), 1e-8)
    a = np.c_[(x - mu) / sd, np.ones(len(x))]
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if balanced else np.ones(len(y))
    step = 1 / (0.25 * np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 / len(x) + l2 + 1e-12)
    b = old = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        c = b + (t - 1) / t2 * (b - old)
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        g = a.T @ (w * (p - y)) / len(x)
        g[:-1] += l2 * c[:-1]
        new = c - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        moved = new - b
        if (c - new) @ moved > 0:
            t2 = 1.0
        old, b, t = b, new, t2
        if np.abs(moved).max() < 1e-7 and np.abs(new - c).max() < 1e-7:
            break
    out = b.copy()
    out[:-1] = b[:-1] / sd
    out[-1] = b[-1] - (out[:-1] * mu).sum()
    return out


def auc(y: np.ndarray, s: np.ndarray) -> float | None:
    y, s = np.asarray(y) > 0, np.asarray(s, float)
    ok = np.isfinite(s)
    y, s = y[ok], s[ok]
    p, n = int(y.sum()), int((~y).sum())
    if not p or not n:
        return None
    names, at, count = np.unique(s, return_inverse=True, return_counts=True)
    rank = np.cumsum(count) - (count - 1) / 2
    return float((rank[at][y].sum() - p * (p + 1) / 2) / (p * n))


def cv_auc(x: np.ndarray, y: np.ndarray, fold: np.ndarray, l1: float = 0.0, l2: float = 0.0) -> float | None:
    """AUC of out-of-fold scores, all folds together."""
    x = np.nan_to_num(x)
    s = np.full(len(y), np.nan)
    for f in np.unique(fold):
        train, test = fold != f, fold == f
        if len(np.unique(y[train] > 0)) < 2:
            return None
        c = logistic(x[train], (y[train] > 0).astype(float), l1, l2)
        s[test] = x[test] @ c[:-1] + c[-1]
    return auc(y, s)
