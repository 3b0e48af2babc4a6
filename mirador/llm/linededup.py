"""Line dedup with levelled sorted runs of line hashes.

A run holds, for each line key of one batch, a 128-bit hash, the number of documents that hold it and its holder, the largest
doc_id. Runs are tables bucketed and sorted by hash, so a batch is merged against them without a shuffle of the runs. Batches
arrive with the largest doc_ids first: a batch's keys are merge-anti-joined with the runs, the keys that no run has get their
holder from this batch, known keys only add to their count. When a level has `fanout` runs they are compacted into one run of
the next level.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one document when documents are counted,
and each is returned; a null doc_id is the smallest; lines end at \\n only; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import BLANKS, materialise, scratch_root

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Up to this many keys the lines to drop are looked up beside the text (24 bytes a key); beyond it they are joined.
LOOKUP_KEYS = 200_000
_STRIP = BLANKS.encode()


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None for keys of fewer than `least` code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, doc_id) for each key of each row, once a row."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {k for line in (text.as_py() or b"").split(b"\n") if (k := line_key(line, least))}
                keys += found
                own += [doc] * len(found)
            k1, k2 = _halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(own, pa.int64())], ["k1", "k2", "doc_id"])

    return slim.mapInArrow(run, "k1 long, k2 long, doc_id long")


class LineRuns:
    """Levelled runs of (k1, k2, n_docs, holder). Batches must not share doc_ids, and come by falling doc_id."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        # as many buckets as a shuffle has partitions: a batch's keys then lie as the runs' do, and a task writes one file
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self._names: list[str] = []

    def add(self, lines: DataFrame) -> DataFrame:
        """lines: distinct (k1, k2, doc_id) of a batch. Returns its run; holder is null for keys that earlier runs have."""
        each = lines.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        # a merge of sorted runs; a key that no run has is new here (the anti join), all others only add to their count
        new = F.lit(True)
        for n, run in enumerate(r for level in self.levels for r in level):
            each = each.join(run.select("k1", "k2", F.lit(True).alias(f"_in{n}")).hint("merge"), ["k1", "k2"], "left")
            new = new & F.col(f"_in{n}").isNull()
        own = self._written(each.select("k1", "k2", "n_docs", F.when(new, F.col("holder")).alias("holder")))
        self.levels[0].append(own)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._written(merged(level)))
                self.levels[k] = []
        return own

    def all(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return runs[0] if len(runs) == 1 else merged(runs)

    def close(self) -> None:
        """Takes the runs' names out of the catalog; their files go with the scratch folder."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _written(self, df: DataFrame) -> DataFrame:
        name = f"runs_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name)
        self._names.append(name)
        return self.spark.table(name)


def merged(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs merged into one: counts add up, a key has at most one holder.

    Outer merge joins of two at a time, without a shuffle as the runs lie in equal buckets. (A union of bucketed tables passes for
    bucketed in Spark 4.1, but its columnar form doesn't line the buckets up, so an aggregation on it leaves keys apart.)
    """
    both = runs[0]
    for r in runs[1:]:
        other = r.select("k1", "k2", F.col("n_docs").alias("_n"), F.col("holder").alias("_h"))
        both = both.join(other.hint("merge"), ["k1", "k2"], "full")
        n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))
        both = both.select("k1", "k2", n.alias("n_docs"), F.greatest("holder", "_h").alias("holder"))
    return both


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = 3, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """(the keys to drop with their holder, all line hashes of docs). Batches are ranges of doc_id, the largest first."""
    lines = materialise(line_hashes(docs, least_chars).distinct())
    cuts = sorted(set(lines.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)))
    runs = LineRuns(docs.sparkSession, fanout)
    edges = [None, *[int(c) for c in cuts], None]
    try:
        found = _merged_batches(runs, lines, edges, least_docs)
    finally:
        runs.close()
    return found, lines


def _merged_batches(runs: LineRuns, lines: DataFrame, edges: list[int | None], least_docs: int) -> DataFrame:
    """The keys that least_docs documents have, after all batches between the edges have been added, the largest doc_ids first."""
    for lo, hi in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        part = lines if hi is None else lines.where(F.col("doc_id") < hi)
        # the smallest range also has the rows without doc_id
        part = part.where(F.col("doc_id") >= lo) if lo is not None else (lines.where(F.col("doc_id").isNull() | (F.col("doc_id") < hi)) if hi is not None else part)
        runs.add(part)
    return materialise(runs.all().where(F.col("n_docs") >= least_docs).select("k1", "k2", "holder"))


def _kept(doc: int | None, text: bytes | None, drop, least: int) -> tuple[int, int, bytes]:
    """Lines, lines dropped, and what stays; drop(key) tells whether this document loses the key."""
    lines = (text or b"").split(b"\n")
    stay = [line for line in lines if not ((k := line_key(line, least)) and drop(k))]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, lookup_keys: int = LOOKUP_KEYS, digest: bool = False) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_lines, n_dropped and kept (the text that stays, or with digest its SHA-256)."""
    found, lines = repeated_lines(docs, least_chars, least_docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    n = found.count()
    looked: dict | None = None
    if n <= lookup_keys:  # checked: at most lookup_keys rows of three longs
        rows = found.collect()
        key = np.array([(r["k1"], r["k2"]) for r in rows], dtype=">i8").reshape(-1, 2)
        looked = {k.tobytes(): r["holder"] for k, r in zip(key, rows, strict=True)}
        held = docs.sparkSession.sparkContext.broadcast(looked)
    else:
        lost = lines.join(found, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        lost = lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_lost")).withColumnRenamed("doc_id", "_doc")
        slim = slim.join(lost.hint("shuffle_hash"), slim["doc_id"].eqNullSafe(F.col("_doc")), "left").select("doc_id", "_text", "_lost")
    joined = looked is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if joined else held.value
        for batch in batches:
            out = []
            lists = batch.column(2).to_pylist() if joined else [None] * batch.num_rows
            for doc, text, lost in zip(batch.column(0).to_pylist(), batch.column(1), lists, strict=True):
                if joined:
                    own = {np.array([x["k1"], x["k2"]], dtype=">i8").tobytes() for x in lost or []}
                    drop = own.__contains__
                else:
                    drop = lambda k, doc=doc: k in table and (doc is None or table[k] != doc)
                out.append((doc, *_kept(doc, text.as_py(), drop, least_chars)))
            ids, n_lines, n_dropped, kept = zip(*out, strict=True) if out else ((), (), (), ())
            kept = pa.array([hashlib.sha256(k).hexdigest() if digest else k.decode("utf-8", "replace") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept], ["doc_id", "n_lines", "n_dropped", "kept"])

    return slim.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def op10_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents."""
    return drop_lines(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


_TRIMMED = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (SELECT doc_id, pos, line, {_TRIMMED} AS key FROM lines),
found AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.holder AS lost FROM keyed k LEFT JOIN found f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
