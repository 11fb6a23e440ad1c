"""Connected components of links that lie in a table, in rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeseam.llm.shared import materialise


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0 .. n-1 reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """links (a, b), longs, a != b -> (node, label): for every node in a link the
    smallest node of its component.  Alternates large-star and small-star: each
    is one aggregation and one join by key, and written to the shared folder, so
    no group is ever gathered; ends when a round changes nothing."""
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = materialise(edges, "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: larger neighbours go to the smallest of v and its neighbours
        edges = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        # small star: smaller neighbours and v itself go to the smallest
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        moved = edges.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v")
        edges = materialise(moved.union(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("u").alias("v"), "u")
    return edges.union(roots).distinct().select(F.col("v").alias("node"), F.col("u").alias("label"))
