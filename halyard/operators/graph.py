"""Connected components by alternating stars: each round is two joins and a written table, so no node's edges meet in a task.

The joins are sorted and merged: edges compress so well that the size of their files would let the driver broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import dropped, written

#: Up to so many edges one task walks them; beyond, the rounds below are distributed. Both give the same rows.
SMALL = 200_000


def _kept(edges: DataFrame):
    """The edges written, and their count and sum of hashes, observed on the way."""
    seen = Observation()
    kept = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return kept, (seen.get["n"], seen.get["h"])


def _walk(batches):
    import pandas as pd

    parent: dict = {}
    named: dict = {}

    def key(x):  # a struct comes as a dictionary, which is no key
        if isinstance(x, dict):
            found = tuple(x.values())
            named.setdefault(found, x)
            return found
        return x

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for u, v in zip(pdf.u.tolist(), pdf.v.tolist()):
            u, v = top(key(u)), top(key(v))
            if u != v:
                parent[max(u, v)] = min(u, v)
    found = [(x, top(x)) for x in list(parent)]
    found = [(x, t) for x, t in found if x != t]
    if found:
        yield pd.DataFrame({"u": [named.get(x, x) for x, _ in found], "v": [named.get(t, t) for _, t in found]})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.hint("merge").join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.hint("merge").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """u, v: each node that has an edge and is not the least of its component, and that least node.

    edges: columns u and v of one ordered type; loops and repeats do no harm; no edges give no rows.
    small: up to so many edges one task walks them (SMALL; 0: never).
    """
    now, state = _kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if state[0] <= (SMALL if small is None else small):
        return now.coalesce(1).mapInPandas(_walk, now.schema)
    while True:
        after, found = _kept(_small_star(_large_star(now)))
        dropped(now)
        now, last, state = after, state, found
        if state == last:
            return now


def labelled(nodes: DataFrame, edges: DataFrame, key: str = "id", label: str = "component") -> DataFrame:
    """nodes with the least node of their component; a node without edges is its own."""
    found = components(edges).select(F.col("u").alias(key), F.col("v").alias("_label"))
    return nodes.hint("merge").join(found, key, "left").withColumn(label, F.coalesce("_label", key)).drop("_label")
