"""Connected components by alternating stars (Kiveris et al., 2014), as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge that isn't the smallest of its component.

    The component is its smallest node. Nodes without edges and the smallest nodes themselves aren't returned:
    callers join from their own nodes and fill in. Null ends and loops are ignored. Neighbours are never gathered
    in a list: each step takes a minimum by node, which combines before the shuffle, and writes it; the edges are then
    joined with that table, one row a node, so a hub's edges are a join's skewed side, which adaptive execution deals out.
    Components only ever fall, so the rounds end, after some log(nodes) of them.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    pairs = materialise(pairs)
    was = _mark(pairs)
    while True:
        large, first = _large(pairs)
        small, second = _small(large)
        discard(pairs, large, first, second)
        pairs, now = small, _mark(small)
        if now == was:  # star forests, and only they, stay as they are
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        was = now


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """(node, m): the smallest neighbour of each node that has a smaller one, written."""
    return materialise(pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")))


def _large(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node links its larger neighbours to the smallest of its neighbours and itself: of an edge, the larger end moves."""
    least = _least(pairs)
    moved = pairs.join(least, F.col("lo") == F.col("node"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
    return materialise(moved.distinct()), least


def _small(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node links itself and its smaller neighbours to the smallest of these."""
    least = _least(pairs)
    joined = pairs.join(least, F.col("hi") == F.col("node")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return materialise(joined.union(least.select("node", "m")).distinct()), least
