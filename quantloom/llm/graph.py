"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import saved

FEW_LINKS = 1 << 20


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index each of ``n`` nodes is connected with over the links (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def in_one_task(batches):
    """Components of all links (a, b) of the task."""
    links = [np.column_stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches]
    if links:
        nodes, at = np.unique(np.concatenate(links), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[lowest(len(nodes), at[:, 0], at[:, 1])])], ["node", "root"])


def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, root): the smallest node (a long) each node of ``edges`` (a, b) is connected with.

    Up to ``few`` links, by count, are joined in one task of some 32 MB.  With more, every round sends a node to the smallest of itself
    and its neighbours and contracts the links; the round count grows with the logarithm of a component's size.  Each
    round is written, so a lost executor costs one round.  Both ways give the same rows.
    """
    edges = saved(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    if edges.count() <= few:
        return saved(edges.coalesce(1).mapInArrow(in_one_task, "node long, root long"))
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = saved(both.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        roots = saved(roots.join(step, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root")))
        a, b = step.select(F.col("of").alias("a"), F.col("to").alias("x")), step.select(F.col("of").alias("b"), F.col("to").alias("y"))
        edges = saved(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return roots
