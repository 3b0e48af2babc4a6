"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, everything but letters of any script and digits becomes one blank. An item of n bytes may
differ from a passage by k = n * RATE edits, rounded down; it is split into k + 1 pieces, one of which must occur exactly. The first
eight bytes of each piece (all, if it is shorter) are its anchor; all places of a text are looked up among the anchors of all items at
once, as numbers. A piece that is found is verified up the halves of its item: if a node of p pieces has a match of at most p - 1 edits,
so has one of its halves, hence a hit counts only if the node above it matches with its own budget, and so on to the whole item, with
Myers' bit-parallel distance (1999) on the bytes around the hit. The budgets add up, so no match is missed.

Items whose normalised text is shorter than LEAST_BYTES are matched with a blank at either end, and their numbers must be those of
the passage: there, an edit in a number makes another question. If less than half of such an item are letters (12 * 7 = 84), its signs
count too: it is matched exactly, on words that keep their signs, in lower case and without the punctuation marks at their ends;
its places are those in that text.

Items are taken to the executors in slices of at most SLICE_BYTES (some 50 bytes of index for each 10 bytes of items), a slice after
another, with one pass over the texts for each, so any number of items can be held against the corpus.

Defined results: null, empty and blank texts match nothing, nor do items of punctuation marks only; items of equal normalised text are each
reported; repeated rows are reported each; null ids are carried as null; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import discard, materialise

RATE, LEAST_BYTES, SLICE_BYTES = 0.10, 24, 4_000_000
#: Bytes of a piece that are looked up, places of a text that are looked up at a time, and patterns whose masks are kept.
ANCHOR, PLACES, KEPT = 8, 1 << 18, 4096
#: Bytes beside a place that are seen with it.
SIDE = 80
#: ASCII letters, digits and all bytes of longer characters stay, all else is a blank.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKS = b".,;:!?\"'`()[]{}"


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_TABLE).split())


def signed(text: str | None) -> bytes:
    """The words with their signs, without the punctuation marks at their ends."""
    return b" ".join(w for word in (text or "").lower().encode("utf-8", "replace").split() if (w := word.strip(_MARKS)))


def by_signs(text: str) -> bool:
    """Whether an item is matched by its signed words: it is short and less than half of it are letters."""
    bare = signed(text).replace(b" ", b"")
    return len(normalised(text)) < LEAST_BYTES and 2 * sum(97 <= b <= 122 or b >= 128 for b in bare) < len(bare)


def myers(pattern: bytes, text: bytes, most: int, masks: dict[int, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best match of the pattern anywhere in the text with at most `most` edits; the earliest of these."""
    m = len(pattern)
    peq = masks if masks is not None else masks_of(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
            if not score:
                break
    return best


def masks_of(pattern: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


class Matcher:
    """Items (key, normalised text), ready to be found in normalised texts. Plain arrays, so that it travels well."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE, exact: bool = False):
        """exact: no edits, whatever the length of an item."""
        self.items = items
        self.short = [exact or len(t) < LEAST_BYTES for _, t in items]
        self.budgets = [0 if exact else int(len(t) * rate) for _, t in items]
        of: dict[int, list[tuple[int, ...]]] = {}
        for n, k in enumerate(self.budgets):
            pattern = self.pattern(n)
            for piece in range(k + 1):
                lo, hi = self.cut(n, piece), self.cut(n, piece + 1)
                size = min(ANCHOR, hi - lo)
                words = [int.from_bytes(pattern[x : x + size], "little") for x in (lo, hi - size)]
                of.setdefault(size, []).append((*words, n, piece, hi - lo, *self._beside(n, piece)))
        # for each length of anchors, by anchor: the piece's last bytes, item, piece, length, and where the piece beside it lies
        self.anchors = {}
        for size, own in of.items():
            word, tail = (np.array([x[k] for x in own], dtype=np.uint64) for k in (0, 1))
            order = np.argsort(word, kind="stable")
            bits = max(10, min(24, int(np.ceil(np.log2(len(own)))) + 4))
            table = np.zeros(1 << bits, dtype=bool)
            table[_hash(word, bits)] = True
            rest = [np.array([x[k] for x in own], dtype=kind)[order] for k, kind in ((2, np.int32), (3, np.int32), (4, np.int32), (5, np.int16), (6, np.int16))]
            halves = np.array([x[7] for x in own], dtype=np.uint32)[order], np.array([x[8] for x in own], dtype=np.uint32)[order]
            self.anchors[size] = (word[order], tail[order], *rest, *halves, table, bits)

    def _beside(self, n: int, piece: int) -> tuple[int, int, int, int]:
        """Where the two halves of the piece that shares a node of two with this one are, from this one's start, and their first four
        bytes: of a node with one edit either is unchanged, at most one place off. Zeros if the node is another one or they are shorter."""
        first, last = 0, self.budgets[n] + 1
        while last - first > 2:
            mid = (first + last) // 2
            first, last = (first, mid) if piece < mid else (mid, last)
        if last - first < 2:
            return 0, 0, 0, 0
        own, pattern = self.cut(n, piece), self.pattern(n)
        other = first if piece != first else first + 1
        lo, hi = self.cut(n, other), self.cut(n, other + 1)
        mid = (lo + hi) // 2
        if mid - lo < 4 or hi - lo > 32:
            return 0, 0, 0, 0
        return lo - own, mid - own, *(int.from_bytes(pattern[x : x + 4], "little") for x in (lo, mid))

    def pattern(self, n: int) -> bytes:
        """What is looked for: short items between blanks."""
        return b" " + self.items[n][1] + b" " if self.short[n] else self.items[n][1]

    def cut(self, n: int, piece: int) -> int:
        return (len(self.items[n][1]) + 2 * self.short[n]) * piece // (self.budgets[n] + 1)

    def __call__(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance): for each item its best passage, of equals the one that ends first."""
        if not self.items or not text:
            return []
        return _Search(self, b" " + text + b" ").found(len(text))


def _hash(word: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class _Search:
    """One matcher on one text, which has a blank at either end."""

    #: Masks of patterns by matcher and node, a bounded number of them.
    masks: dict[tuple, dict[int, int]] = {}

    def __init__(self, matcher: Matcher, text: bytes):
        self.of, self.text = matcher, text
        self.best: dict[int, tuple[int, int, int]] = {}
        self.tried: set[tuple] = set()

    def found(self, size: int) -> list[tuple[int, int, int, int]]:
        for from_ in range(0, len(self.text), PLACES):
            self.tried.clear()
            self._look(from_)
        out = []
        for n, (distance, end, start) in sorted(self.best.items()):
            blank = self.of.short[n]  # the blanks aren't part of the passage
            start, end = max(0, start + blank - 1), min(size, end - blank - 1)
            out.append((n, start, max(start, end), distance))
        return out

    def _look(self, from_: int) -> None:
        # some bytes around the places that are looked up, and blanks where the text ends
        lead = min(from_, SIDE)
        some = self.text[from_ - lead : from_ + PLACES + SIDE]
        places = min(PLACES, len(some) - lead)
        some = some + b" " * (SIDE + ANCHOR)
        words = np.ndarray(len(some) - ANCHOR + 1, dtype="<u8", buffer=some, strides=(1,)).astype(np.uint64)
        for size, (anchors, tails, items, pieces, lengths, x1, x2, h1, h2, table, bits) in self.of.anchors.items():
            own = words & np.uint64((1 << 8 * size) - 1) if size < ANCHOR else words
            at = np.flatnonzero(table[_hash(own[lead : lead + places], bits)]) + lead
            lo, hi = np.searchsorted(anchors, own[at], "left"), np.searchsorted(anchors, own[at], "right")
            n_hits = hi - lo
            at = np.repeat(at, n_hits)
            entry = np.arange(len(at)) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + np.repeat(lo, n_hits)
            # the end of the piece, if it is near
            ok = (lengths[entry] > SIDE) | (own[np.minimum(at + lengths[entry] - size, len(own) - 1)] == tails[entry])
            at, entry = at[ok], entry[ok]
            ok = (x1[entry] == 0) & (x2[entry] == 0)
            for x, half in ((x1, h1), (x2, h2)):
                for off in (-1, 0, 1):
                    place = at + x[entry] + off
                    # outside of what is in sight nothing is ruled out but by the text's ends
                    ok |= (place < 0) & (from_ > lead)
                    ok |= (words[np.clip(place, 0, len(words) - 1)] & np.uint64(0xFFFFFFFF)).astype(np.uint32) == half[entry]
            at, entry = at[ok] + from_ - lead, entry[ok]
            for place, n, piece in zip(at.tolist(), items[entry].tolist(), pieces[entry].tolist(), strict=True):
                self._try(n, piece, place)

    def _try(self, n: int, piece: int, place: int) -> None:
        was = self.best.get(n)
        if was and not was[0] and was[1] <= place:
            return
        pattern, lo, hi = self.of.pattern(n), self.of.cut(n, piece), self.of.cut(n, piece + 1)
        if self.text[place : place + hi - lo] != pattern[lo:hi]:
            return
        diagonal = place - lo
        hit = self._verify(n, piece, pattern, diagonal)
        if hit and (was is None or hit < was) and (not self.of.short[n] or _numbers(self.text[hit[2] : hit[1]]) == _numbers(pattern)):
            self.best[n] = hit

    def _verify(self, n: int, piece: int, pattern: bytes, diagonal: int) -> tuple[int, int, int] | None:
        """(distance, end, start) of the best passage on or near the diagonal."""
        text = self.text
        if diagonal >= 0 and text[diagonal : diagonal + len(pattern)] == pattern:
            return 0, diagonal + len(pattern), diagonal
        first, last = 0, self.of.budgets[n] + 1
        nodes = []
        while last - first > 1:
            nodes.append((first, last))
            mid = (first + last) // 2
            first, last = (first, mid) if piece < mid else (mid, last)
        hit = None
        for first, last in reversed(nodes):
            key = (n, first, last, diagonal)
            if key in self.tried:
                return None
            self.tried.add(key)
            a, b, budget = self.of.cut(n, first), self.of.cut(n, last), last - first - 1
            lo = max(0, diagonal + a - budget)
            hit = myers(pattern[a:b], text[lo : max(0, diagonal + b + budget)], budget, self._masks(n, first, last, pattern[a:b]))
            if hit is None:
                return None
        if hit is None:
            return None
        distance, end = hit[0], hit[1] + lo
        back = myers(pattern[::-1], text[max(0, end - len(pattern) - distance) : end][::-1], distance)
        return distance, end, end - (back[1] if back else len(pattern))

    def _masks(self, *key) -> dict[int, int]:
        *node, pattern = key
        own = (id(self.of), *node)
        got = self.masks.get(own)
        if got is None:
            if len(self.masks) >= KEPT:
                self.masks.clear()
            got = self.masks[own] = masks_of(pattern)
        return got


_NUMBER = re.compile(rb"[0-9]+")


def _numbers(passage: bytes) -> list[bytes]:
    return _NUMBER.findall(passage)


def slices(benchmark: DataFrame, most: int = SLICE_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in slices of at most `most` characters (or of one item), brought to the driver one slice after another."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if held and size + len(r["text"]) > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held:
        yield held


class Finder:
    """From a text to the (item_id, start, stop, distance) that it holds."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.plain = Matcher([(k, b) for k, t in items if not by_signs(t) and (b := normalised(t))], rate)
        self.signs = Matcher([(k, b) for k, t in items if by_signs(t) and (b := signed(t))], rate, exact=True)

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        hits = [(self.plain.items[n][0], *hit) for n, *hit in self.plain(normalised(text))] if self.plain.items else []
        return hits + [(self.signs.items[n][0], *hit) for n, *hit in self.signs(signed(text))] if self.signs.items else hits


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, start, stop, distance) for each item found in each row of docs; places in the normalised text, in bytes."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, start int, stop int, distance int"
    found = None
    for part in slices(benchmark, most):
        held = spark.sparkContext.broadcast(Finder(part, rate))  # a slice at most
        one = materialise(slim.mapInArrow(_finding(held), schema))
        held.destroy()
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], schema)


def _finding(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = held.value
        for batch in batches:
            out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in finder(text.as_py())]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start", "stop", "distance"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs in which no item is found, all columns whatever their names. Only texts go to Python, nothing is joined; between
    two slices of items the rows that are left are written."""
    spark, was = docs.sparkSession, None
    for part in slices(benchmark, most):
        if was is not None:
            docs = materialise(docs)
            was[1].destroy()
            discard(was[0])
        held = spark.sparkContext.broadcast(Finder(part, rate))  # a slice at most
        was = docs, held
        docs = docs.where(~_holds(held)(F.col("text")))
    return docs


def _holds(held):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        finder = held.value
        return pa.array([bool(finder(t.as_py())) for t in texts], pa.bool_())

    return holds


def op9_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, stop, distance: all benchmark items found in all documents."""
    return matches(docs, benchmark)
