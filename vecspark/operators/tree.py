"""Trees over a bounded set of vectors (centroids or a sample): built on the driver, searched in batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from vecspark.functions.metrics import numpy_distance


@dataclass
class Node:
    """A ball-tree node: its centre's row (-1 at the root) and its children; a leaf lists its rows as children."""

    centre: int
    children: list[int] = field(default_factory=list)


def even_kmeans(x: np.ndarray, k: int, metric: str = "L2", weight: float = 0.0, rounds: int = 20) -> np.ndarray:
    """Labels by k-means from evenly spaced rows, each distance raised by ``weight`` times the size in the round before.

    The last assignment has no weight; labels without rows are left out by callers.
    """
    far = numpy_distance(metric)
    c, size = x[np.linspace(0, len(x) - 1, k).astype(int)].copy(), np.zeros(k)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = (far(x, c) + weight * size).argmin(1)
        size = np.bincount(new, minlength=k).astype(float)
        c = np.array([x[new == j].mean(0) if size[j] else c[j] for j in range(k)])
        if (new == label).all():
            break
        label = new
    return far(x, c).argmin(1) if weight else label


def even_weight(x: np.ndarray, k: int, metric: str = "L2", weights: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)) -> float:
    """The weight (a number over the rows) whose clusters are the most even, by deviation over mean of their sizes."""

    def unevenness(w: float) -> float:
        size = np.bincount(even_kmeans(x, k, metric, w / len(x)))
        size = size[size > 0]
        return float(size.std() / size.mean())

    return min(weights, key=lambda w: (unevenness(w), w)) / len(x)


def build_bkt(x: np.ndarray, kmeans_k: int = 32, leaf_size: int = 8, metric: str = "L2", weight: float | None = 0.0) -> list[Node]:
    """A balanced k-means tree; every row is the centre of exactly one node. Without a weight, the root's choice of one holds.

    The member nearest to its cluster's mean becomes the child's centre, the others go below it.
    """
    nodes = [Node(-1)]
    stack = [(0, np.arange(len(x)))]
    far = numpy_distance(metric)
    if weight is None:
        weight = even_weight(x, min(kmeans_k, len(x)), metric) if len(x) else 0.0
    while stack:
        at, rows = stack.pop()
        if len(rows) <= leaf_size:
            parts = [rows[i : i + 1] for i in range(len(rows))]
        else:
            label = even_kmeans(x[rows], min(kmeans_k, len(rows)), metric, weight)
            parts = [rows[label == j] for j in np.unique(label)]
            if len(parts) == 1:  # equal rows can't be told apart
                parts = np.array_split(rows, min(kmeans_k, len(rows)))
        for p in sorted(parts, key=lambda p: (-len(p), int(p[0]))):
            mid = int(p[far(x[p].mean(0)[None, :], x[p])[0].argmin()])
            nodes.append(Node(mid))
            nodes[at].children.append(len(nodes) - 1)
            if len(p) > 1:
                stack.append((len(nodes) - 1, p[p != mid]))
    return nodes


def subtree_heads(nodes: list[Node], select: int, split: int, factor: int) -> list[int]:
    """Rows chosen as heads, from the leaves up.

    A node whose unchosen rows below number ``select`` or more is chosen and counts nothing upward; over
    ``split``, its largest children are chosen too, one for every ``factor`` rows.
    """
    size, chosen = [0] * len(nodes), set()
    for at in range(len(nodes) - 1, -1, -1):  # children come after their parent
        node = nodes[at]
        n = 1 + sum(size[c] for c in node.children)
        if n >= select and node.centre >= 0:
            if n > split:
                largest = sorted(node.children, key=lambda c: (-size[c], c))[: -(-n // factor)]
                chosen.update(nodes[c].centre for c in largest if size[c])
            chosen.add(node.centre)
            n = 0
        size[at] = n
    return sorted(chosen)


def select_heads(nodes: list[Node], n: int, ratio: float, select: int = 0, split: int = 0, factor: int = 0) -> list[int]:
    """Heads that number ``ratio`` of the rows, as nearly as a search over the split threshold finds."""
    top = max(1, n - 1)
    select = select or min(top, max(1, int(1 / ratio)))
    factor = factor or max(1, min(top, round(1 / ratio)))
    if split:
        return subtree_heads(nodes, select, split, factor)
    best, low, high = None, 2, max(2, min(top, 2 * select))
    while low <= high:
        mid = (low + high) // 2
        heads = subtree_heads(nodes, select, mid, factor)
        gap = abs(len(heads) / n - ratio)
        if best is None or gap < best[0]:
            best = (gap, heads)
        if len(heads) / n > ratio:
            low = mid + 1
        else:
            high = mid - 1
    return best[1] or [nodes[1].centre]


def search_bkt(nodes: list[Node], x: np.ndarray, q: np.ndarray, k: int, metric: str = "L2", graph: list[np.ndarray] | None = None, leaves: int = 100, max_check: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, distances)`` of the nearest found: best-first down the tree, then along the graph's edges."""
    import heapq

    far = numpy_distance(metric)
    near = lambda rows: far(q[None, :], x[rows])[0]
    met: dict[int, float] = {}
    queue = [(-np.inf, 0)]
    while queue and len(met) < leaves:
        _, at = heapq.heappop(queue)
        kids = nodes[at].children
        if kids:
            rows = np.array([nodes[c].centre for c in kids])
            for c, r, d in zip(kids, rows.tolist(), near(rows).tolist(), strict=True):
                met[r] = d
                heapq.heappush(queue, (d, c))
    if graph is not None:
        expand, checked = [(d, r) for r, d in met.items()], 0
        heapq.heapify(expand)
        while expand and checked < max_check:
            _, r = heapq.heappop(expand)
            checked += 1
            new = np.array([v for v in graph[r] if v not in met], int)
            for v, d in zip(new.tolist(), near(new).tolist() if len(new) else [], strict=True):
                met[v] = d
                heapq.heappush(expand, (d, v))
    rows = np.array(list(met), int)
    d = np.array(list(met.values()))
    order = np.lexsort((rows, d))[:k]
    return rows[order], d[order]


@dataclass
class Split:
    """A KD-tree node: rows at a leaf, else a dimension, its value and two sides."""

    rows: np.ndarray | None = None
    dim: int = 0
    value: float = 0.0
    left: int = -1
    right: int = -1


def build_kdt(x: np.ndarray, leaf_size: int = 1) -> list[Split]:
    """Splits on the dimension that varies most, at its median."""
    nodes, stack = [Split()], [(0, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        part = x[rows]
        dim = int(part.var(0).argmax()) if len(rows) else 0
        value = float(np.median(part[:, dim])) if len(rows) else 0.0
        low = part[:, dim] < value if len(rows) else np.zeros(0, bool)
        if len(rows) <= leaf_size or low.all() or not low.any():
            nodes[at].rows = rows
            continue
        nodes += [Split(), Split()]
        nodes[at] = Split(None, dim, value, len(nodes) - 2, len(nodes) - 1)
        stack += [(len(nodes) - 2, rows[low]), (len(nodes) - 1, rows[~low])]
    return nodes


def search_kdt(nodes: list[Split], x: np.ndarray, q: np.ndarray, k: int, metric: str = "L2", candidates: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Near sides first, until twice ``k`` rows (or ``candidates``) are met; those are ordered exactly."""
    want, rows, stack = candidates or 2 * k, [], [0]
    while stack and len(rows) < want:
        node = nodes[stack.pop()]
        if node.rows is not None:
            rows += node.rows.tolist()
        else:
            first, last = (node.left, node.right) if q[node.dim] < node.value else (node.right, node.left)
            stack += [last, first]
    found = np.array(rows, int)
    d = numpy_distance(metric)(q[None, :], x[found])[0]
    order = np.lexsort((found, d))[:k]
    return found[order], d[order]
