"""SimHash near-duplicates through an inverted index on the bytes of fingerprints.

A posting of the index is a byte value at one of the eight byte positions. Fingerprints that differ in at most 3 bits differ
in at most 3 bytes, so they share 5 postings at least. Postings by single byte hold 1/256 of all rows, so the index is keyed
by three postings at a time: with the postings of a fingerprint in order of how rare they are, two that share 5 of 8 have 3 in
common among the first 6 of each; a pair therefore meets under one of the 20 triples of either's rarest six. Pairs that meet
have their shared bytes counted, those with the guaranteed 5 are kept, and the bits that differ are counted. All of it works on
distinct fingerprints: copies are one entry, and keys with many entries are compared block by block.

Defined results: a null or blank text has fingerprint 0, which links like any other; a text of one or two words is one
shingle; repeated rows are returned each; rows with a null doc_id get the component of their fingerprint's documents, null if
none of these has a doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.blocks import linked
from mirador.llm.common import all_of, free_name, materialise, with_row_id
from mirador.llm.graph import components

SEED, SHINGLE, MOST_BITS = 42, 3, 3
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_WEIGHT = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, as unsigned 64 bits."""
    words = (text or b"").lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _WEIGHT):
        some = zip(starts[at : min(n, at + _WEIGHT)].tolist(), ends[at + shingle - 1 : min(n, at + _WEIGHT) + shingle - 1].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in some], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs and _fp, the fingerprint of text as a signed long."""
    slim = docs.select(*keep, F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp, pa.int64())], [*keep, "_fp"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return slim.mapInArrow(run, f"{schema}, _fp long")


def _bytes(fp: np.ndarray) -> np.ndarray:
    return fp.astype(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)


def _keyed(distinct: DataFrame, rare: np.ndarray) -> DataFrame:
    """(_key, _fp): the 20 triples of each fingerprint's six rarest postings."""
    triples = np.array(list(combinations(range(6), 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            b = _bytes(fp).astype(np.int64)
            postings = b + 256 * np.arange(8)
            order = np.argsort(rare[postings], axis=1, kind="stable")  # rare gives each posting a place of its own
            first = np.sort(np.take_along_axis(postings, order[:, :6], axis=1), axis=1)
            three = first[:, triples]  # ascending, so by position
            key = (three[:, :, 0] << 22) | (three[:, :, 1] << 11) | three[:, :, 2]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp, len(triples)))], ["_key", "_fp"])

    return distinct.mapInArrow(run, "_key long, _fp long")


def _close(left: list, right: list, same: bool) -> tuple[np.ndarray, np.ndarray]:
    x, y = _bytes(np.array(left)), _bytes(np.array(right))
    found = []
    for at in range(0, len(x), 256):  # 256 * block * 8 bytes at a time
        differ = x[at : at + 256, None, :] ^ y[None, :, :]
        i, j = np.nonzero((differ == 0).sum(axis=2, dtype=np.uint8) >= 8 - MOST_BITS)
        ok = _POPCOUNT[differ[i, j]].sum(axis=1, dtype=np.int64) <= MOST_BITS
        found.append((i[ok] + at, j[ok]))
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    ok = i < j if same else np.ones(len(i), dtype=bool)
    return i[ok], j[ok]


def near_duplicates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep (doc_id among them), _fp, _class (of linked fingerprints) and component_id: the smallest doc_id that links
    reach, each row of docs."""
    prints = materialise(fingerprints(docs, keep))
    distinct = materialise(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")))
    # a count for each of the 2048 postings at most
    position = [F.col("_fp").bitwiseAND(F.lit(0)) + F.expr(f"shiftrightunsigned(_fp, {56 - 8 * p}) & 255L") + 256 * p for p in range(8)]
    counts = distinct.select(F.explode(F.array(*position)).alias("p")).groupBy("p").count().collect()
    often = np.zeros(2048, dtype=np.int64)
    for r in counts:
        often[r["p"]] = r["count"]
    rare = np.empty(2048, dtype=np.int64)
    rare[np.argsort(often, kind="stable")] = np.arange(2048)
    edges = linked(_keyed(distinct.select("_fp"), rare), "_key", "_fp", _close)
    labels = components(edges)
    reached = distinct.join(labels, distinct["_fp"] == labels["node"], "left").select("_fp", F.coalesce("component", "_fp").alias("_class"), "_least")
    # classes of distinct fingerprints: the smallest doc_id of each, back to its fingerprints
    smallest = reached.groupBy("_class").agg(F.min("_least").alias("component_id"))
    by_fp = reached.join(smallest, "_class").select("_fp", "_class", "component_id")
    return prints.join(by_fp, "_fp")


def op7_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    found = near_duplicates(docs, ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each class of linked fingerprints one row stays, the one with the smallest doc_id (null after
    all others; of equal doc_ids the row that is read first). Rows are judged by their texts: rows that share a doc_id but not a class
    are documents of their own. All columns are returned, whatever their names."""
    rid = free_name(docs, "_rid")
    rows = with_row_id(docs, rid)
    found = near_duplicates(rows.select("doc_id", "text", F.col(rid).alias("_rid")), ["doc_id", "_rid"])
    found = materialise(found.select("doc_id", "_rid", "_class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("_first")
    stay = found.groupBy("_class").agg(first).select("_first._rid")
    # written, so that its size is known: while the copies are few, the texts needn't be shuffled to lose them
    gone = materialise(found.join(stay, "_rid", "left_anti").select(F.col("_rid").alias(rid)))
    return rows.join(gone, rid, "left_anti").select(*all_of(docs))
