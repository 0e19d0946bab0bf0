"""Connected components of an edge table: forests within tasks, then alternating large-star and small-star steps until all are stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, settle

MOST_ROUNDS = 40
#: Edges that a task joins to trees at a time, and about so many to a task.
CHUNK = 500_000


def _minimum(edges: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours v, and their number, as rows (node, least, degree)."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("least"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("u", "node")


def _with_minimum(edges: DataFrame, most_edges: int) -> DataFrame:
    """edges with the least of each u; the hub of a star may have most of the edges."""
    return join_skewed(edges, _minimum(edges), {"u": "node"}, "degree", most_edges)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of the component of each) of edges that are at hand."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, least node) of the components of every CHUNK edges of a task; the edges of a chunk are joined by them."""

    def done(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        some = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(roots[some])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            yield done(held)
            held, n = [], 0
    if n:
        yield done(held)


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("hub")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("hub").alias("hub")).where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("hub") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (u long, v long); root is the least node of the component.

    Loops and repeated edges do no harm; a node that only has a loop is left out. No edges give an empty result.
    """
    tidy = settle(_tidy(edges))
    now = settle(tidy.coalesce(max(1, -(-tidy.count() // CHUNK))).mapInArrow(_trees, "u long, v long"))
    for _ in range(MOST_ROUNDS):
        if _all_stars(now):
            break
        total = now.count()
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = _tidy(large)
        small = _with_minimum(large, total)
        small = small.select(F.explode(F.array(F.struct("v", "least"), F.struct(F.col("u").alias("v"), "least"))).alias("e"))
        now = settle(_tidy(small.select(F.col("e.v").alias("u"), F.col("e.least").alias("v"))))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
