"""Connected components of links, without ever holding all links in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from answerflow.llm.common import store


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as the links (a, b), as links from each node to its smallest."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, nearer := new[new]):
            new = nearer
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the links (a, b) that is not the smallest of its
    component; `component` is that smallest node.

    Links point from the larger node to the smaller. Each round hangs a node's other targets
    below its smallest target and then skips one step (pointer doubling), so the rounds grow
    with the logarithm of the longest path. Smallest targets are partial minima; no node's
    links are gathered in one task.
    """
    links = store(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while True:
        low = links.groupBy("a").agg(F.min("b").alias("low"))
        hung = links.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("low").alias("b")),
                    F.struct(F.greatest("b", "low").alias("a"), F.col("low").alias("b")),
                )
            ).alias("e")
        )
        hung = hung.select("e.a", "e.b").where("a <> b").distinct()
        target = hung.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("beyond"))
        links = store(
            hung.join(target, "b", "left").select("a", F.coalesce("beyond", "b").alias("b"), F.col("beyond").isNotNull().alias("moved")),
            "links",
        )
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("nodes"), F.max("moved").alias("moved")
        ).first()
        if not state.moved and state.n == state.nodes:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        links = links.select("a", "b").distinct()
