"""Graph-sparse projection: prize-collecting Steiner trees by moat growing, and a search for a wanted size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PRUNINGS = ("none", "simple", "gw", "strong")


def steiner_forest(edges: list[tuple[int, int, float]], prizes: np.ndarray, clusters: int = 1, pruning: str = "strong", root: int | None = None) -> tuple[list[int], list[int]]:
    """(nodes, edge numbers) of a forest of ``clusters`` trees that trades edge costs against missed prizes.

    All nodes with a prize grow moats at equal speed; an edge whose moats meet joins two clusters, a cluster that has
    used up its prize stops. Growth ends when no more than ``clusters`` active clusters are left. With a ``root`` the
    result is the one tree that holds it: its cluster never grows, and growth ends when no cluster does.
    """
    if pruning not in PRUNINGS:
        raise ValueError(f"pruning must be one of {PRUNINGS}")
    n = len(prizes)
    if np.any(prizes < 0) or any(c < 0 or not (0 <= a < n and 0 <= b < n) for a, b, c in edges):
        raise ValueError("prizes and costs must not be negative, nodes within range")
    starts, ends, costs = np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int), np.array([e[2] for e in edges], float)
    # by cluster, whose number is a node's: prize left and whether it grows; by node: its cluster and its moat
    owner, members = np.arange(n), {k: [k] for k in range(n)}
    left, active, moat = prizes.astype(float), prizes > 0, np.zeros(n)
    taken, dead, eps = [], [], 1e-12
    if root is not None:
        active[root], clusters = False, 0
    while np.count_nonzero(active) > clusters:
        growing = np.flatnonzero(active)
        stop = int(growing[np.argmin(left[growing])])
        step, meet = left[stop], -1
        at, to = owner[starts], owner[ends]
        speed = active[at].astype(int) + active[to]
        between = np.flatnonzero((at != to) & (speed > 0))
        wait = np.maximum(0.0, costs[between] - moat[starts[between]] - moat[ends[between]]) / speed[between]
        sooner = wait < step - eps
        for i, when in zip(between[sooner].tolist(), wait[sooner].tolist(), strict=True):
            if when < step - eps:
                step, meet = when, i
        left[growing] -= step
        moat[active[owner]] += step
        if meet < 0:
            active[stop] = False
            dead.append(set(members[stop]))
            continue
        x, y = int(at[meet]), int(to[meet])
        taken.append(meet)
        owner[members[y]] = x
        members[x] = members[x] + members.pop(y)
        left[x] += left[y]
        active[y] = False
        rooted = root is not None and owner[root] == x
        active[x] = left[x] > eps and not rooted
        if not active[x] and not rooted:
            dead.append(set(members[x]))
    roots = [int(owner[root])] if root is not None else np.flatnonzero(active).tolist() or [max(members, key=lambda k: prizes[members[k]].sum())]
    if pruning == "none":
        nodes = sorted({v for k in members for v in members[k] if len(members[k]) > 1} | {v for k in roots for v in members[k]})
        return nodes, sorted(taken)
    inside = {v for k in roots for v in members[k]}
    kept = {i for i in taken if edges[i][0] in inside and edges[i][1] in inside}
    if pruning == "gw":
        for group in reversed(dead):
            across = [i for i in kept if (edges[i][0] in group) != (edges[i][1] in group)]
            if len(across) == 1:
                kept = {i for i in kept - set(across) if not (edges[i][0] in group and edges[i][1] in group)}
                inside -= group
    elif pruning == "strong":
        inside, kept = _strong(edges, prizes, kept, [members[k] for k in roots], root)
    return sorted(inside), sorted(kept)


def _strong(edges, prizes, kept: set[int], trees: list[list[int]], root: int | None = None) -> tuple[set[int], set[int]]:
    """By tree, the subtree of the largest prizes minus costs; with a root, the best one that holds it."""
    near: dict[int, list[tuple[int, int, float]]] = {}
    for i in kept:
        a, b, c = edges[i]
        near.setdefault(a, []).append((b, i, c))
        near.setdefault(b, []).append((a, i, c))
    nodes: set[int] = set()
    used: set[int] = set()
    for tree in trees:
        top = tree[0] if root is None else root
        order, parent, stack = [], {top: (-1, -1, 0.0)}, [top]
        while stack:
            v = stack.pop()
            order.append(v)
            for u, i, c in near.get(v, []):
                if u not in parent:
                    parent[u] = (v, i, c)
                    stack.append(u)
        worth = {v: float(prizes[v]) for v in order}
        for v in reversed(order):
            up, _, c = parent[v]
            if up >= 0 and worth[v] > c:
                worth[up] += worth[v] - c
        best = max(order, key=lambda v: worth[v]) if root is None else root
        chosen = {best}
        for v in order:
            up, i, c = parent[v]
            if up in chosen and v not in chosen and worth[v] > c:
                chosen.add(v)
                used.add(i)
        nodes |= chosen
    return nodes, used


def project(edges: list[tuple[int, int, float]], w: np.ndarray, low: int, high: int, rounds: int = 20, clusters: int = 1, pruning: str = "gw") -> list[int]:
    """Nodes of a forest with between ``low`` and ``high`` nodes, by doubling and then halving the weight of the costs."""
    prizes = w * w
    run = lambda lam: steiner_forest([(a, b, c * lam) for a, b, c in edges], prizes, clusters, pruning)[0]
    small, large = 0.0, float(np.sort(prizes)[::-1][min(high, len(prizes)) - 1]) or 1e-9
    found = run(large)
    left = rounds
    while len(found) > high and left:
        small, large, left = large, 2 * large, left - 1
        found = run(large)
    while not low <= len(found) <= high and left:
        middle, left = (small + large) / 2, left - 1
        nodes = run(middle)
        if len(nodes) > high:
            small = middle
        else:
            large, found = middle, nodes
    return found


def project_tasks(vectors: DataFrame, edges: list[tuple[int, int, float]], low: int, high: int) -> DataFrame:
    """(task_id, j, w): each task's vector (task_id, j, w) kept on its projection; one grouped-map task for each vector."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        w = pdf["w"].to_numpy()
        keep = np.zeros(len(w), bool)
        keep[project(edges, w, low, high)] = True
        return pd.DataFrame({"task_id": pdf["task_id"], "j": pdf["j"], "w": np.where(keep, w, 0.0)})

    return vectors.groupBy("task_id").applyInPandas(run, "task_id long, j int, w double")


def grid_edges(rows: int, columns: int, cost: float = 1.0) -> list[tuple[int, int, float]]:
    """The edges of a grid graph, for fixtures."""
    at = lambda r, c: r * columns + c
    return [(at(r, c), at(r, c + 1), cost) for r in range(rows) for c in range(columns - 1)] + [(at(r, c), at(r + 1, c), cost) for r in range(rows - 1) for c in range(columns)]
