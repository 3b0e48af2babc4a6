"""Verified links between rows of the same key, in blocks: no pair rows, no group in one task.

Rows of a key are cut into blocks of bounded size; each pair of blocks is a task group of its own. A group is compared in
numpy and leaves a spanning forest of its links, at most one edge a row, which has the same components as all its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import materialise

BLOCK = 2048
#: Numbers in the payloads of a block, 4 MB as 32-bit ones.
BLOCK_WEIGHT = 1 << 20


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) of the components that the links a[i]-b[i] make of 0..n-1; the root is the smallest."""
    root = np.arange(n)
    while True:  # hook the larger root below the smaller one, then flatten
        ra, rb = root[a], root[b]
        hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
        if not (hi != lo).any():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    return [(i, int(r)) for i, r in enumerate(root) if i != r]


def linked(
    rows: DataFrame, key: str, node: str, links: Callable[[list, list, bool], tuple[np.ndarray, np.ndarray]], payloads: DataFrame | None = None,
    block: int = BLOCK, weight: str | None = None, most: int = BLOCK_WEIGHT,
) -> DataFrame:
    """(a, b): a forest of the links within each key. rows: distinct (key long, node long); payloads: (node, payload), a row a
    node, brought only to nodes that meet others; without it a node is its own payload. weight: a column of rows, the length of the
    payload; a block holds `block` rows and `most` of that in the mean, so long payloads make more blocks.

    links(payloads of one block, of another, same block) gives the index pairs that verify; it may hold block * block
    numbers at a time, no more.
    """
    heavy = F.sum(weight) if weight else F.lit(0)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"), F.greatest(F.ceil(F.count("*") / block), F.ceil(heavy / most)).cast("int").alias("_blocks"))
    # written, so that the rows of a frequent key are the skewed side of a join, which adaptive execution deals out
    counts = materialise(counts.where("_n > 1").drop("_n"))
    dealt = rows.join(counts, key)
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    # a row meets the rows of each other block once: in the pair of its own block and that one
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(
        F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_task"),
        F.col(key).alias("_key"), F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        "_own", F.col(node).alias("_node"),
    )
    if payloads is None:
        dealt = dealt.withColumn("_payload", F.col("_node"))
    else:
        dealt = dealt.join(payloads.select(F.col(node).alias("_node"), F.col("payload").alias("_payload")), "_node")
    order = ["_task", "_key", "_i", "_j"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "_task").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in (*order, "_own", "_node", "_payload")]
            out: list[tuple[int, int]] = []
            for task, k, i, j, own, nd, load in zip(*cols, strict=True):
                if at != (task, k, i, j):
                    out += _edges(held, at, links)
                    held, at = [], (task, k, i, j)
                held.append((own, nd, load))
            if out:
                yield _batch(out)
        if held and (out := _edges(held, at, links)):
            yield _batch(out)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def _edges(held: list[tuple], at: tuple | None, links: Callable) -> list[tuple[int, int]]:
    """The forest of one group: within the block if it is paired with itself, else between its two blocks."""
    if len(held) < 2:
        return []
    held = sorted(held, key=lambda r: r[:2])
    same = at[2] == at[3]
    cut = len(held) if same else sum(r[0] == at[2] for r in held)
    left, right = held[:cut], held if same else held[cut:]
    if not left or not right:
        return []
    x, y = links([r[2] for r in left], [r[2] for r in right], same)
    return [(held[i][1], held[r][1]) for i, r in forest(len(held), x, y if same else y + cut)]
