"""Connected groups: union-find over arrays inside a task, stars over tables between tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.shared import discard, made_since, mark, written


def roots_of(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the groups of each pair; the least number of a group is its root."""
    while x.size:
        rx, ry = roots_of(parent, x), roots_of(parent, y)
        differ = rx != ry
        x, y = x[differ], y[differ]
        np.minimum.at(parent, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't its group's least: alternating large and small stars until nothing moves."""
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        # large star: each greater neighbour of a node points at the least of the node and its neighbours
        mins = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours point at the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        before = made_since(mark() - 1)
        now = written(small, "edges")
        last, seen = seen, state(now)
        discard(now.sparkSession, before)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def least_ids(names: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, class_id) of every node in a group of several: the least ``rep`` of the group. ``names``: (node, rep)."""
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(names, "node")
    return members.join(members.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("node", "class_id")
