"""Substring dedup: passages of over 50 words that repeat across documents, by paragraph MinHash banding.

Words are runs without blanks, in lower case (A-Z). Two things are repeats:

- Paragraphs: lines of at least LEAST_WORDS words, and blocks of several shorter lines between these and blank ones, so that text
  which is wrapped at other places compares too. MinHash over five-word shingles, BANDS bands of ROWS values: paragraphs at Jaccard 0.8
  collide with probability 1 - (1 - 0.8^3)^8 = 0.997. Of those that collide, pairs with AGREE of all 24 values equal (probability 0.996
  at 0.8) are read again and verified by exact Jaccard >= 0.8 on their shingles' 64-bit hashes, block by block, and clustered by
  connected components.
- Passages: any run of LEAST_WORDS words that two documents share, wherever it begins and however its lines break. Winnowing (Schleimer
  et al., 2003) takes, of every LEAST_WORDS - WINDOW + 1 windows in a row, the one whose hash is least, so two documents with the same run
  take the same window of it. Runs whose window repeats are compared by the hash of the run itself: two hashes of 64 bits must agree
  before a word is removed. All such runs are found, hence whole passages to their ends.

A repeat is kept in the document with the smallest doc_id of its cluster and removed from all others. Documents are classed by the
components that their repeats make.

Defined results: null, empty and short texts have no paragraphs; a passage that repeats within one document only isn't a repeat; rows
of one doc_id are one document here and are returned each; rows with a null doc_id have no repeats and a null class; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.llm.blocks import linked
from mirador.llm.common import discard, materialise
from mirador.llm.graph import components

LEAST_WORDS, WINDOW, SHINGLE = 51, 32, 5
BANDS, ROWS, JACCARD, AGREE = 8, 3, 0.8, 14
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 15
PLACE = ["doc_id", "word_from", "word_to"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64; those of texts up to 65 536 words are kept."""
    kept = _powers_of.get(base)
    if kept is None or len(kept) < n:
        p = np.full(max(n, 1 << 16), base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        p[0] = 1
        kept = np.cumprod(p, dtype=np.uint64)
        if n <= 1 << 16:
            _powers_of[base] = kept
    return kept[:n]


def _upto(numbers: np.ndarray) -> np.ndarray:
    """Running sums modulo 2^64, from 0."""
    out = np.empty(len(numbers) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(numbers, out=out[1:])
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k words in a row: polynomials modulo 2^64 from running sums, mixed."""
    if len(words) < k:
        return np.empty(0, dtype=np.uint64)
    upto = _upto(words * _powers(_BASE, len(words)))
    return _mixed((upto[k:] - upto[:-k]) * _powers(_BACK, len(words) - k + 1))


def winnowed(hashes: np.ndarray, of: int) -> np.ndarray:
    """The place of the least hash, the last of equals, for each run of `of`; none if there are fewer. Runs double in length until they
    are as long."""
    if len(hashes) < of:
        return np.empty(0, dtype=np.int64)
    at, width = np.arange(len(hashes)), 1
    while width < of:
        step = min(width, of - width)
        later = hashes[step:] <= hashes[:-step]
        at = np.where(later, at[step:], at[:-step])
        hashes = np.minimum(hashes[step:], hashes[:-step])
        width += step
    return at


def anchors(hashes: np.ndarray, of: int) -> np.ndarray:
    """The places that winnowing takes, each once."""
    at = winnowed(hashes, of)
    return at[np.flatnonzero(np.diff(at, append=-1))]  # at never falls


_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


_MOST = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z are in lower case
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """The bytes of a text in pieces that end with a blank, so that no word is cut; about _PIECE bytes, but no shorter than a word."""
    data = np.frombuffer(text, dtype=np.uint8)
    at = 0
    while len(data) - at > _PIECE:
        end = at + _PIECE
        while end < len(data):  # a word may be longer than a piece
            blank = np.flatnonzero(_BLANK[data[end : end + _PIECE]])
            end += blank[0] + 1 if len(blank) else _PIECE
            if len(blank):
                break
        end = min(end, len(data))
        yield data[at:end]
        at = end
    if at < len(data):
        yield data[at:]


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words, number of words of each line).

    A word's hash is a polynomial modulo 2^64 of a random number for each of its bytes, mixed: the same wherever the word stands. A piece
    of text is hashed at once, no word by itself.
    """
    hashes, ends, n = [], [], 0
    for data in _pieces(text):
        blank = np.ones(len(data) + 2, dtype=bool)
        np.take(_BLANK, data, out=blank[1:-1])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        lo, hi = edges[::2], edges[1::2]
        upto = _upto(np.take(_BYTE, data) * _powers(_BASE, len(data)))
        hashes.append(_mixed((upto[hi] - upto[lo]) * _powers(_BACK, len(data))[lo]))
        ends.append(np.searchsorted(lo, np.flatnonzero(data == 10)) + n)
        n += len(lo)
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    return np.concatenate(hashes), np.diff(np.concatenate(ends), prepend=0, append=n)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set of shingle hashes, 32 bits of each. These are mixed already, so a product orders them anew."""
    least = _MOST
    for at in range(0, len(shingles), 4096):  # a bounded table at a time
        table = shingles[at : at + 4096] ^ _B[:, None]
        table *= _A[:, None]
        least = np.minimum(least, table.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bands(signature_: Column) -> Column:
    """A key for each band of a signature."""
    key = lambda k: F.xxhash64(k, *[F.get(signature_, k * ROWS + r) for r in range(ROWS)])
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)


def _key(words: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64))


def _rows(line: bool, key, doc, lo, hi, lists: list | None, name: str, kind: pa.DataType) -> pa.RecordBatch:
    n = len(key)
    lists = pa.nulls(n, pa.list_(kind)) if lists is None else pa.array(lists, pa.list_(kind))
    cols = [pa.array(np.full(n, line)), pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), lists]
    return pa.RecordBatch.from_arrays(cols, ["line", "key", *PLACE, name])


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first word, end) of the paragraphs among lines of these sizes: long lines, and blocks of several shorter lines between those and
    blank ones."""
    at = start = lines = 0
    for n in [*sizes, 0]:
        if 0 < n < LEAST_WORDS:
            lines += 1
            at += n
            continue
        if lines > 1 and at - start >= LEAST_WORDS:
            yield start, at
        if n:
            yield at, at + n
        at += n
        start, lines = at, 0


def paragraphs(docs: DataFrame) -> DataFrame:
    """(line, key, doc_id, word_from, word_to, signature): winnowed windows and, as lines, paragraphs, which alone have signatures. key is
    the hash of the words."""
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("_text"))
    schema = "line boolean, key long, doc_id long, word_from int, word_to int, signature array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, at, blocks = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, sizes = words_of(text.as_py() or b"")
                if len(h) < LEAST_WORDS:
                    continue
                five = grams(h, SHINGLE)
                for lo, hi in _blocks(sizes.tolist()):
                    blocks.append((_key(h[lo:hi]), doc, lo, hi, signature(five[lo : hi - SHINGLE + 1])))
                windows = grams(h, WINDOW)
                places = anchors(windows, LEAST_WORDS - WINDOW + 1)
                keys.append(windows[places].view(np.int64))
                own.append(np.full(len(places), doc))
                at.append(places.astype(np.int32))
            if keys:
                place = np.concatenate(at)
                yield _rows(False, np.concatenate(keys), np.concatenate(own), place, place + np.int32(WINDOW), None, "signature", pa.int32())
            if blocks:
                key, doc, lo, hi, b = zip(*blocks, strict=True)
                yield _rows(True, key, doc, lo, hi, list(b), "signature", pa.int32())

    return slim.mapInArrow(run, schema)


def _similar(left: list, right: list, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at Jaccard >= JACCARD, from the postings of the right block."""
    sizes = np.array([len(r) for r in right])
    shingle = np.concatenate([np.asarray(r) for r in right])
    row = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, row = shingle[order], row[order]
    a, b = [], []
    for i, own in enumerate(left):
        lo, hi = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
        n = hi - lo
        upto = np.cumsum(n)
        if not upto[-1]:
            continue
        both = np.bincount(row[np.repeat(lo - upto + n, n) + np.arange(upto[-1])], minlength=len(right))
        j = np.nonzero(both >= JACCARD * (len(own) + sizes - both))[0]
        j = j[j > i] if same else j
        a.append(np.full(len(j), i))
        b.append(j)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _clustered(rows: DataFrame) -> DataFrame:
    """rows(key, ...) whose key lies in several documents, with keeper, the smallest of these, instead of the key. The keys are written, so
    that the rows of a frequent key are the skewed side of a join, which adaptive execution deals out."""
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last")).where("keeper < _last").drop("_last")
    return rows.join(materialise(keys), "key").drop("key")


def looked_up(docs: DataFrame, hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, key, doc_id, word_from, word_to, shingles), of one more pass over the texts that are asked for: the runs whose winnowed window
    is in hits(doc_id, word_from), with the hash of the run as key; and as lines, the paragraphs wanted(node, doc_id, word_from, word_to) with
    the hashes of their shingles."""
    hits = hits.groupBy("doc_id").agg(F.collect_list("word_from").alias("_hits"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("word_from", "word_to", "node")).alias("_wanted"))
    asked = materialise(hits.join(wanted, "doc_id", "full"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text")).join(asked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, own, paragraphs_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                h, _ = words_of(text.as_py() or b"")
                if len(h) < LEAST_WORDS:
                    continue
                if own.is_valid:
                    hit = np.zeros(len(h), dtype=bool)
                    at = own.values.to_numpy(zero_copy_only=False)
                    hit[at[at < len(h)]] = True  # rows of one doc_id may have texts of several lengths
                    at = np.flatnonzero(hit[winnowed(grams(h, WINDOW), LEAST_WORDS - WINDOW + 1)]).astype(np.int32)
                    key = grams(h, LEAST_WORDS)[at].view(np.int64)
                    yield _rows(False, key, np.full(len(at), doc), at, at + np.int32(LEAST_WORDS), None, "shingles", pa.int64())
                if paragraphs_.is_valid:
                    five, out = grams(h, SHINGLE), []
                    for lo, hi, node in (tuple(p.values()) for p in paragraphs_.as_py()):
                        if hi <= len(h) and _key(h[lo:hi]) == node:
                            out.append((node, doc, lo, hi, np.unique(five[lo : hi - SHINGLE + 1]).view(np.int64)))
                    if out:
                        yield _rows(True, *zip(*out, strict=True), "shingles", pa.int64())

    found = materialise(slim.mapInArrow(run, "line boolean, key long, doc_id long, word_from int, word_to int, shingles array<long>"))
    discard(asked)
    return found


def _agreeing(left: list, right: list, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose signatures have AGREE values in common at least."""
    x, y = np.array(left, dtype=np.int32), np.array(right, dtype=np.int32)
    a, b = [], []
    for at in range(0, len(x), 128):  # 128 * block * 24 bytes at a time
        i, j = np.nonzero((x[at : at + 128, None, :] == y[None, :, :]).sum(axis=2, dtype=np.uint8) >= AGREE)
        ok = i + at < j if same else np.ones(len(i), dtype=bool)
        a.append(i[ok] + at)
        b.append(j[ok])
    return np.concatenate(a), np.concatenate(b)


def _similar_components(met: DataFrame, payloads: DataFrame) -> DataFrame:
    """(node, component) of similar paragraphs. The first band links most; of the others, only keys whose nodes aren't all of one
    component yet can change anything, so the nodes of all other keys aren't compared again."""
    compare = lambda rows: linked(rows, "band", "node", _similar, payloads, weight="n")
    first = materialise(compare(met.where("not later")))
    labels = components(first)
    rest = met.where("later").join(labels, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("_label"))
    open_ = materialise(rest.groupBy("band").agg(F.min("_label").alias("_a"), F.max("_label").alias("_b")).where("_a < _b").select("band"))
    rest = materialise(rest.join(open_, "band", "left_semi").drop("_label"))
    return components(first.unionByName(compare(rest)))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, word_from, word_to, keeper): the paragraphs and runs that lie in several documents; keeper: the smallest of these."""
    all_ = materialise(paragraphs(docs))
    lines = all_.where("line")
    distinct = lines.groupBy("key").agg(F.min(F.struct(*PLACE, "signature")).alias("_at"))
    distinct = materialise(distinct.select(F.col("key").alias("node"), *[F.col(f"_at.{c}").alias(c) for c in (*PLACE, "signature")]))
    keyed = distinct.select("node", (F.col("word_to") - F.col("word_from")).alias("n"), F.posexplode(bands(F.col("signature"))).alias("_at", "band"))
    keyed = materialise(keyed.select("node", "n", "band", (F.col("_at") > 0).alias("later")))
    close = materialise(linked(keyed.select("band", "node"), "band", "node", _agreeing, distinct.select("node", F.col("signature").alias("payload"))))
    # only paragraphs that have a likely partner are read again
    likely = materialise(close.select(F.col("a").alias("node")).union(close.select("b")).distinct())
    met = materialise(keyed.join(likely, "node", "left_semi"))
    wanted = distinct.select("node", *PLACE).join(likely, "node", "left_semi")
    hits = _clustered(all_.where("not line").select("key", "doc_id", "word_from"))
    read = looked_up(docs, hits, wanted)
    discard(keyed, close)

    labels = _similar_components(met, read.where("line").select(F.col("key").alias("node"), F.col("shingles").alias("payload"))).withColumnRenamed("node", "key")
    own = lines.select("key", *PLACE).join(labels, "key", "left").select(F.coalesce("component", "key").alias("key"), *PLACE)
    runs = _clustered(read.where("not line").select("key", "doc_id", "word_from")).withColumn("word_to", F.col("word_from") + LEAST_WORDS)
    found = materialise(_clustered(own).unionByName(runs))
    discard(all_, distinct, likely, met, read)
    return found


_RANGES = pa.list_(pa.struct([("word_from", pa.int32()), ("word_to", pa.int32())]))


def merged(lo: np.ndarray, hi: np.ndarray) -> list[dict[str, int]]:
    """Ranges that overlap or touch as one, in order; a sort and one pass."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, upto = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > upto[:-1])))
    last = np.concatenate((first[1:] - 1, [len(lo) - 1]))
    return [{"word_from": a, "word_to": b} for a, b in zip(lo[first].tolist(), upto[last].tolist(), strict=True)]


def documents(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_repeats (passages that other documents have), n_removed (those that another document
    keeps), words_removed, removed (their word ranges; repeats that overlap or touch are one) and component_id."""
    found = repeats(docs)
    by = found.groupBy("doc_id").agg(F.collect_list(F.struct("word_from", "word_to", (F.col("doc_id") != F.col("keeper")).alias("gone"))).alias("_own"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_repeats, removed = [], []
            for own in batch.column(1):
                lo, hi, gone = (own.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                n_repeats.append(len(merged(lo, hi)))
                removed.append(merged(lo[gone], hi[gone]))
            words = [sum(r["word_to"] - r["word_from"] for r in ranges) for ranges in removed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_repeats, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, _RANGES)], ["doc_id", "n_repeats", "words_removed", "removed"])

    ranges = "array<struct<word_from:int,word_to:int>>"
    by = by.mapInArrow(gathered, f"doc_id long, n_repeats long, words_removed long, removed {ranges}")
    labels = components(found.where("doc_id <> keeper").select(F.col("doc_id").alias("a"), F.col("keeper").alias("b")))
    by = by.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(by, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = F.coalesce("removed", F.array().cast(ranges)).alias("removed")
    return rows.select("doc_id", zero("n_repeats").alias("n_repeats"), F.size(removed).cast("long").alias("n_removed"), zero("words_removed").alias("words_removed"), removed, F.coalesce("component", "doc_id").alias("component_id"))


def op3_substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_repeats, n_removed, words_removed, component_id of all documents."""
    return documents(docs).drop("removed")
