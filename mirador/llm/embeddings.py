"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 and rounded to 127ths. With x = x' + e, where x' is what the int8 codes stand for,
cos(x, y) <= x'.y' + |e_x| |y'| + |x'| |e_y| + |e_x| |e_y|; lengths of codes and errors are known exactly for each vector, so a
pair whose code product is below the threshold less that bound cannot link. Code products of a tile pair are one matrix product
(in float32, which holds these integers exactly); pairs possibly at the threshold are recomputed in double precision.

Equal vectors are one entry with a count; a tile pair leaves, for each vector, how many rows it links with, and a spanning
forest of its links, so hot groups yield neither pair rows nor long lists. The work grows with the square of the distinct
vectors, as the method does; memory is bounded by two tiles.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows are copies, each returned and counted; a null vec_id links with nothing and gets a
null component; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.blocks import forest
from mirador.llm.common import materialise
from mirador.llm.graph import components

#: A tile's vectors take TILE_BYTES at most in double precision; below that, tiles of TILE rows and more are as few as keep all tasks
#: busy, for each tile travels once for each other one. PRODUCTS: numbers in a strip of a tile pair's products.
TILE, TILE_BYTES, PRODUCTS = 4096, 1 << 25, 1 << 22
#: Over the rounding of a float64 product of unit vectors of a few thousand components.
_ROUNDING = 1e-9


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, int8 codes as float32, lengths of what codes stand for, lengths of errors."""
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    q = np.rint(u * 127.0)
    return u, q.astype(np.int8).astype(np.float32), np.sqrt((q * q).sum(axis=1)) / 127.0, np.sqrt(((u - q / 127.0) ** 2).sum(axis=1))


def links(x: np.ndarray, y: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (x, y) with cosine >= least; within one tile each pair once."""
    ux, qx, lx, ex = _unit(x)
    uy, qy, ly, ey = (ux, qx, lx, ex) if same else _unit(y)
    a, b = [], []
    strip = max(16, PRODUCTS // max(1, len(y)))
    for at in range(0, len(x), strip):
        e, n = ex[at : at + strip], lx[at : at + strip]
        # the largest error and length of the other tile keep the bound rigorous
        bound = e * ly.max() + n * ey.max() + e * ey.max() + _ROUNDING
        product = qx[at : at + strip] @ qy.T
        i, j = np.nonzero(product >= np.floor((least - bound) * 127.0 * 127.0)[:, None].astype(np.float32))
        if same:
            i, j = i[i + at < j], j[i + at < j]
        for k in range(0, len(i), 1 << 17):  # in double precision, a bounded number at a time
            ii, jj = i[k : k + (1 << 17)] + at, j[k : k + (1 << 17)]
            ok = np.einsum("ij,ij->i", ux[ii], uy[jj]) >= least
            a.append(ii[ok])
            b.append(jj[ok])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _compared(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of one or two tiles: (a, b, n): a links with n rows more, and a hangs on b where b is not null."""
    group = group.sort_values("tile")
    tiles = []
    for _, r in group.iterrows():
        ids, n = np.frombuffer(r["ids"], dtype="<i8"), np.frombuffer(r["counts"], dtype="<i8")
        tiles.append((ids, n, np.frombuffer(r["vectors"], dtype="<f8").reshape(len(ids), -1)))
    same = len(tiles) == 1
    (ia, na, xa), (ib, nb, xb) = tiles[0], tiles[-1]
    i, j = links(xa, xb, same, least)
    if not len(i):
        return pd.DataFrame({"a": [], "b": [], "n": []})
    more_a, more_b = np.bincount(i, weights=nb[j], minlength=len(ia)), np.bincount(j, weights=na[i], minlength=len(ib))
    ids, more = (ia, more_a + more_b) if same else (np.concatenate([ia, ib]), np.concatenate([more_a, more_b]))
    edges = forest(len(ids), i, j if same else j + len(ia))
    has = np.nonzero(more)[0]
    a = [*ids[has].tolist(), *(int(ids[e[0]]) for e in edges)]
    b = [*[None] * len(has), *(int(ids[e[1]]) for e in edges)]
    n = [*more[has].astype(np.int64).tolist(), *[0] * len(edges)]
    return pd.DataFrame({"a": pd.array(a, dtype="Int64"), "b": pd.array(b, dtype="Int64"), "n": pd.array(n, dtype="Int64")})


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("id")
    x = np.stack(group["v"].to_numpy()).astype("<f8")
    return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "tile": [int(group["tile"].iloc[0])], "ids": [group["id"].to_numpy().astype("<i8").tobytes()], "counts": [group["n"].to_numpy().astype("<i8").tobytes()], "vectors": [x.tobytes()]})


def near_duplicate_vectors(rows: DataFrame, least: float = 0.9, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """rows(vec_id, embedding) as vec_id, n_links (other rows linked directly), component_id, kept. tile: rows that a tile has at least,
    where there are more than one; tile_bytes: what its vectors take at most."""
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("_v"))
    # scaled by the largest component, so that squares neither overflow nor vanish
    big = F.array_max(F.transform("_v", lambda x: F.abs(x)))
    valid = F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0) & finite & F.exists("_v", lambda x: x != 0)
    v = v.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    v = materialise(v.withColumn("_v", F.when(F.col("_ok"), F.transform("_v", lambda x: x / big))))
    reps = materialise(v.where("_ok").groupBy("_v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumnRenamed("_v", "v"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_dim = reps.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("_of"))
    busy = F.least(F.ceil(F.col("_of") / tile), F.lit(math.ceil(math.sqrt(2 * n))))  # k tiles make k (k + 1) / 2 pairs
    by_dim = by_dim.withColumn("tiles", F.greatest(busy, F.ceil(F.col("_of") * F.col("dim") * 8 / tile_bytes)).cast("int")).drop("_of")
    dealt = reps.withColumn("dim", F.size("v")).join(by_dim, "dim").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = dealt.groupBy("dim", "tile").applyInPandas(_packed, "dim int, tile int, ids binary, counts binary, vectors binary")
    tiles = materialise(tiles.join(by_dim, "dim"))
    # each tile meets each other once: under the pair of both numbers
    met = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    met = met.repartition(n, "dim", "i", "j")
    # a tile whose partner is empty meets itself only under its own pair
    found = met.groupBy("dim", "i", "j").applyInPandas(_pair(least), "a long, b long, n long")
    found = materialise(found)
    more = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    labels = components(found.where("b is not null").select("a", "b"))
    reps = reps.join(more, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    reps = reps.select("v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = v.where("_ok").join(reps, F.col("_v") == F.col("v")).select("vec_id", "n_links", "component_id")
    alone = v.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _pair(least: float):
    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[1] != key[2] and len(group) < 2:
            return pd.DataFrame({"a": [], "b": [], "n": []})
        return _compared(group, least)

    return compare


def op5_embedding_dedup(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings, at cosine 0.9."""
    return near_duplicate_vectors(rows).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", "kept")
