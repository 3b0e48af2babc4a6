"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `vnodes` points on the ring. A unit (all rows of one text) belongs to the first point clockwise of the hash
of its text; if that point's shard is full, it goes on clockwise to the first that isn't. A shard is full at (1 + slack)
of an equal share of all bytes, so sizes are near equal and only what overflows moves when shards are added.

Two kinds of unit make this a bounded computation at any input size. Units over 1/1000 of a shard are fewer than 1000 per
shard: these are placed one by one, the largest first. All others are placed as what flows over the ring's arcs: their
bytes are summed by arc (shards * vnodes rows), the arcs' overflow is carried clockwise, and a unit goes where the running
sum of its arc falls, off by a unit of under 1/1000 of a shard at most. A text that holds more than a quarter of a shard is
split into units by doc_id, so that a group of a third of all rows fills several shards.

Defined results: a null text is an empty one (size 8, CRC 0); repeated rows are rows of their own, those of the same doc_id
and text stay together; null doc_ids are one key; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.common import materialise, running_start, with_row_id

#: Units of over 1/HEAVY of a shard are placed one by one; texts of over 1/WHOLE of a shard are split.
HEAVY, WHOLE = 1000, 4
#: Rows numbered by one task.
CHUNK_ROWS = 20_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all points, ascending, and their shards. Points of a shard depend on nothing but its number."""
    at = np.array([xxhash.xxh64_intdigest(f"{s}#{v}") for s in range(shards) for v in range(vnodes)], dtype=np.uint64)
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(np.arange(shards), vnodes)[order]


def place_heavy(units: list[tuple[int, int]], owner: np.ndarray, load: list[float], cap: float) -> list[int]:
    """units: (arc, bytes); adds to load. The largest first, each to the first shard clockwise that has room for it."""
    placed = [0] * len(units)
    for k in sorted(range(len(units)), key=lambda k: (-units[k][1], units[k][0], k)):
        arc, size = units[k]
        tried: set[int] = set()
        found = None
        for step in range(len(owner)):
            s = int(owner[(arc + step) % len(owner)])
            if s not in tried and load[s] + size <= cap:
                found = s
                break
            tried.add(s)
            if len(tried) == len(load):
                break
        placed[k] = min(range(len(load)), key=lambda s: (load[s], s)) if found is None else found
        load[placed[k]] += size
    return placed


def carry(arcs: dict[int, int], owner: np.ndarray, load: list[float], cap: float) -> list[tuple[int, int, int, int]]:
    """(arc, from byte, to byte, shard): where the bytes of each arc go; adds to load. Own shards first, then clockwise."""
    parts, over = [], []
    for arc in sorted(arcs):
        s, size = int(owner[arc]), arcs[arc]
        fits = int(max(0, min(size, cap - load[s])))
        if fits:
            parts.append((arc, 0, fits, s))
            load[s] += fits
        if fits < size:
            over.append((arc, fits, size))
    for arc, at, size in over:
        step = 0
        while at < size:
            step += 1
            s = int(owner[(arc + step) % len(owner)])
            fits = int(max(0, min(size - at, cap - load[s])))
            if step > 2 * len(owner):  # rounding has left no room
                s, fits = min(range(len(load)), key=lambda s: load[s]), size - at
            if fits:
                parts.append((arc, at, at + fits, s))
                load[s] += fits
                at += fits
    return parts


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 1024, slack: float = 0.001, row_id: str | None = None) -> DataFrame:
    """_rid, doc_id, size, text_crc32, shard and slot (from 0 without gaps, in each shard) of all docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"), *([F.col(row_id).alias("_rid")] if row_id else []),
    )
    slim = materialise(slim) if row_id else with_row_id(slim)
    all_bytes, n = (int(x or 0) for x in slim.agg(F.sum("size"), F.count("*")).first())
    share = max(all_bytes, 1) / shards
    at, owner = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, h.to_numpy().astype(np.int64).view(np.uint64)) % len(at))

    groups = slim.groupBy("_text").agg(F.sum("size").alias("_bytes"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_bytes") / (share / WHOLE)))
    # fewer than shards * HEAVY rows, for each holds more than that part of all bytes
    heavy = groups.where(F.col("_bytes") > share / HEAVY).select("_text", F.when(pieces < 2, 1).otherwise(pieces).alias("_pieces"))
    rows = slim.join(F.broadcast(heavy), "_text", "left")
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64("doc_id"), F.col("_pieces")))
    rows = materialise(rows.withColumn("_place", F.when(F.col("_piece") > 0, F.xxhash64("_text", "_piece")).otherwise(F.col("_text"))))

    load = [0.0] * shards
    cap = (1 + slack) * share
    units = [tuple(r) for r in rows.where("_piece is not null").groupBy("_text", "_piece").agg(F.first("_place").alias("p"), F.sum("size").alias("b")).withColumn("a", arc_of("p")).select("a", "b", "_text", "_piece").collect()]
    units.sort(key=lambda u: u[2:])
    placed = place_heavy([u[:2] for u in units], owner, load, cap)
    light = rows.where("_piece is null").withColumn("_arc", arc_of("_place"))
    arcs = {r["_arc"]: r["b"] for r in light.groupBy("_arc").agg(F.sum("size").alias("b")).collect()}
    parts = carry(arcs, owner, load, cap)

    heavy_at = spark.createDataFrame([(u[2], u[3], s) for u, s in zip(units, placed, strict=True)], "_text long, _piece long, shard int")
    light_at = spark.createDataFrame(parts, "_arc int, _lo long, _hi long, shard int")
    keep = ["_rid", "doc_id", "size", "text_crc32", "shard"]
    # the running sum in an arc, all rows of a text at once: they share one place
    upto = F.sum("size").over(Window.partitionBy("_arc").orderBy("_text").rangeBetween(Window.unboundedPreceding, 0))
    light = light.withColumn("_upto", upto).join(F.broadcast(light_at), "_arc").where("_upto > _lo and _upto <= _hi").select(*keep)
    heavy_rows = rows.where("_piece is not null").join(F.broadcast(heavy_at), ["_text", "_piece"]).select(*keep)
    done = light.unionByName(heavy_rows)
    chunks = max(1, math.ceil(n / shards / CHUNK_ROWS))
    done = done.withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))).withColumn("_one", F.lit(1).cast("long"))
    return running_start(done, ["shard"], "_chunk", ["doc_id", "_rid"], "_one", "slot").select(*keep, "slot")


def op4_shard_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the contract's 24 shards; the law is that of bytes."""
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
