"""Connected components of an edge table: local union-find forests, merged hierarchically.

Every task contracts the edges it reads into a forest (node -> smallest node it reaches there).
Forests hold at most one edge per node, so merging them in groups shrinks the table level by level
until one task can hold it.  A table that stays too large for one task is finished by rounds of
hooking roots to smaller ones and handing roots down, which never need a whole component in one place,
nor all nodes of one root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.joins import skew_join
from quern.session import cut, drop_cut

#: Edges one task may hold (16 bytes each, about ten times that while it works).
MAX_TASK_EDGES = 1_500_000
FAN_IN = 8
SCHEMA = "node bigint, root bigint"


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that isn't the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        if not len(u):
            break
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = parent != np.arange(len(nodes))
    return nodes[child], nodes[parent[child]]


def _local(limit: int):
    """A task's forest over the edges it reads; memory stays bounded, since a forest above the limit is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def contract() -> tuple[np.ndarray, np.ndarray]:
            return forest_of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def batch_of(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= limit:
                node, root = contract()
                held, n = [(node, root)], len(node)
                if n >= limit // 2:
                    yield batch_of(node, root)
                    held, n = [], 0
        if held:
            yield batch_of(*contract())

    return run


def _step(edges: DataFrame, limit: int) -> DataFrame:
    return edges.mapInArrow(_local(limit), SCHEMA)


def _is_star(forest: DataFrame) -> bool:
    """Whether every child has one root and no root is a child."""
    n, d = forest.agg(F.count("*"), F.count_distinct("node")).first()
    if n != d:
        return False
    roots = forest.select(F.col("root").alias("node")).distinct()
    return roots.join(forest.select("node"), "node", "left_semi").limit(1).count() == 0


def components(edges: DataFrame, max_task_edges: int = MAX_TASK_EDGES, fan_in: int = FAN_IN) -> DataFrame:
    """``node, root`` for every node of ``edges`` (its first two columns, BIGINT) that isn't itself a root.

    The root is the smallest node of the component.  Loops, repeated edges and null ends are
    allowed (an edge with a null end joins nothing); no edges give no rows.
    """
    a, b = edges.columns[:2]
    plain = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root"))
    plain = plain.filter("node is not null and root is not null and node <> root")
    forest = cut(_step(plain, max_task_edges), "forest")
    n = forest.count()
    # Levels of the hierarchy: the forests of `fan_in` tasks meet in one.
    parts = -(-n // max(1, max_task_edges // fan_in))
    while parts > 1 and n > max_task_edges:
        parts = max(1, parts // fan_in)
        merged = cut(_step(forest.repartition(parts), max_task_edges), "forest")
        m = merged.count()
        drop_cut(forest)
        forest, shrunk, n = merged, m < 0.7 * n, m
        if not shrunk:
            break
    if n <= max_task_edges:
        return cut(_step(forest.repartition(1), 2 * max_task_edges), "components")
    width = 2 * fan_in * -(-n // max_task_edges)
    while not _is_star(forest):
        # The roots of a node are connected to the smallest of them.
        lows = cut(forest.groupBy("node").agg(F.min("root").alias("low"), F.count("*").alias("n")), "lows")
        more = forest.join(lows.filter("n > 1").select("node", "low"), "node").filter("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        joined = cut(_step(lows.select("node", F.col("low").alias("root")).unionByName(more).repartition(width, "node"), max_task_edges), "forest")
        # A root that is itself a node hands its own root down.  Roots of very many nodes are broadcast.
        up = joined.groupBy("node").agg(F.min("root").alias("up"))
        held = joined.groupBy("root").agg(F.count("*").alias("_w"))
        hops = cut(held.join(up.withColumnRenamed("node", "root"), "root"), "hops")
        short = skew_join(joined, hops, "root", "_w").select("node", F.col("up").alias("root"))
        rest = joined.join(hops.select("root"), "root", "left_anti").select("node", "root")
        merged = cut(short.unionByName(rest).distinct(), "forest")
        for old in (forest, lows, joined, hops):
            drop_cut(old)
        forest = merged
    return forest
