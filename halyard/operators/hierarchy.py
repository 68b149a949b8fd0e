"""Hierarchical density clusters of bounded windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import COARSE_US


def hierarchy(x: np.ndarray, least: int = 2, samples: int = 2) -> np.ndarray:
    """Labels (-1: noise) of the most stable clusters of at least `least` rows; one cluster of all rows may win.

    Mutual reachability, its minimum spanning tree, the tree of clusters that shed fewer than `least` rows, and the
    selection with the largest excess of mass.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    # minimum spanning tree, grown from row 0
    near, source, inside, edges = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((near[j], source[j], j))
        inside[j] = True
        closer = reach[j] < near
        near, source = np.where(closer, reach[j], near), np.where(closer, j, source)
    # joined from the shortest edge up: node n + k joins two nodes at a distance
    parent, size, children, height = list(range(n)), [1] * n, {}, {}
    top = {i: i for i in range(n)}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (w, a, b) in enumerate(sorted(edges, key=lambda e: (e[0], min(e[1], e[2]), max(e[1], e[2])))):
        ra, rb = find(a), find(b)
        children[n + k], height[n + k] = (top[ra], top[rb]), w
        size.append(size[top[ra]] + size[top[rb]])
        parent[ra] = rb
        top[rb] = n + k

    def rows(node):
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += children[v]
        return out

    # clusters: [node, birth, stability, child clusters]
    clusters = []

    def walk(node, birth):
        me = len(clusters)
        clusters.append([node, 0.0, []])
        stable, level = 0.0, node
        while level >= n:
            rate = 1 / max(height[level], 1e-12)
            a, b = children[level]
            big = [c for c in (a, b) if size[c] >= least]
            if len(big) == 2:
                stable += size[level] * (rate - birth)
                clusters[me][2] = [walk(a, rate), walk(b, rate)]
                break
            if not big:
                stable += size[level] * (rate - birth)
                break
            stable += (size[level] - size[big[0]]) * (rate - birth)
            level = big[0]
        clusters[me][1] = stable
        return me

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * n + 100))
    walk(n + len(edges) - 1, 0.0)
    chosen, best = {}, {}
    for c in reversed(range(len(clusters))):
        _, own, kids = clusters[c]
        below = sum(best[k] for k in kids)
        chosen[c] = not kids or own >= below
        best[c] = own if chosen[c] else below
    labels, todo, number = np.full(n, -1), [0], 0
    while todo:
        c = todo.pop(0)
        if chosen[c]:
            labels[rows(clusters[c][0])] = number
            number += 1
        else:
            todo += clusters[c][2]
    return labels


def window_clusters(df: DataFrame, key: list[str], window_us: int = COARSE_US, visual: float = 0.3, temporal: float = 0.7, samples: int = 2, limit: int = 256) -> DataFrame:
    """id, cluster (null: noise), and skipped for the windows with more than `limit` rows, which are left for review.

    df: key columns (the window), id, clock_us and vector. Bigger windows never reach a task as a whole.
    """
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n"))
    rows = df.join(sizes, key)

    def run(pdf):
        pdf = pdf.sort_values(["clock_us", "id"])
        v = np.array(pdf.vector.tolist(), float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        t = (pdf.clock_us.to_numpy() - pdf.clock_us.iloc[0]) / window_us
        labels = hierarchy(np.column_stack([v * np.sqrt(visual / 2), t * np.sqrt(temporal)]), max(2, samples), samples)
        first = {k: pdf.id.to_numpy()[labels == k].min() for k in set(labels.tolist()) if k >= 0}
        return type(pdf)({"id": pdf.id.tolist(), "cluster": [first.get(k) for k in labels.tolist()], "skipped": False})

    small = rows.where(F.col("_n") <= limit).select(*key, "id", "clock_us", "vector").groupBy(*key).applyInPandas(run, "id string, cluster string, skipped boolean")
    return small.unionByName(rows.where(F.col("_n") > limit).select("id", F.lit(None).cast("string").alias("cluster"), F.lit(True).alias("skipped")))
