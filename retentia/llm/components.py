"""Connected components of a graph given by its links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize


HELD_PAIRS = 1 << 20


class Links:
    """Links found so far among the points of one task, as labels: each point knows the smallest point of its component."""

    def __init__(self, n: int):
        self.label, self._held, self._count = np.arange(n), [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self._held.append((left, right))
        self._count += len(left)
        if self._count > HELD_PAIRS:
            self.settle()

    def settle(self) -> np.ndarray:
        if self._held:
            left, right = map(np.concatenate, zip(*self._held))
            self._held, self._count = [], 0
            while True:
                a, b = self.label[left], self.label[right]
                apart = a != b
                if not apart.any():
                    break
                left, right, a, b = left[apart], right[apart], a[apart], b[apart]
                np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
                while (self.label[self.label] != self.label).any():
                    self.label = self.label[self.label]
        return self.label


def _smallest(edges: DataFrame, at: str, value: Column) -> KeyTable:
    """For each node, its smallest ``value`` over the given edges; partial minima are taken before the shuffle."""
    return KeyTable(edges.groupBy(F.col(at).alias("node")).agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("count")), "node")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node that has a link to another.

    ``edges`` has columns a and b, in either order, of one type that has an order;
    repeats, loops and nulls do no harm. Alternates between linking the larger
    neighbours of each node, and then its smaller ones, with the smallest neighbour, until
    each component is a star. A node with very many links is never one task's work: the
    smallest neighbours are found by partial minima and looked up with hot keys spread.
    """
    plain = edges.filter(F.col("a") != F.col("b"))
    edges = materialize(plain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before, state = None, _state(edges)
    while before != state and state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _smallest(both, "a", F.least("a", "b"))
        larger = least.attach(edges, F.col("a"), ["least"]).select(F.col("least").alias("a"), "b")
        edges = materialize(larger.distinct(), "links")
        least = _smallest(edges, "b", F.col("a"))
        moved = least.attach(edges, F.col("b"), ["least"])
        smaller = moved.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b")
        edges = materialize(smaller.distinct(), "links")
        before, state = state, _state(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
