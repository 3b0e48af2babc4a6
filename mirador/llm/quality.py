"""Quality classifier from weak labels.

Heuristic labellers vote accept, reject or abstain on each text. Expectation maximisation (Dawid and Skene, 1979) over the counts
of vote patterns of all documents estimates each labeller's accuracies and the share of good texts; the posterior of a pattern is
the label of its documents. Posterior labels of at most MOST_FITTED documents, chosen by hash of doc_id, train a linear scorer on
hashed word shapes, repetitions and text statistics; it scores every text whole. No human labels are read.

A text is read once: its votes and inputs are written, and all that follows works on these.

Defined results: null, empty and blank texts have no shapes and are rejected with score 0; repeated rows and null doc_ids are
scored like any other, but rows without doc_id aren't fitted; where no row can be fitted, all texts with words score 0.5; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import all_of, free_name, materialise

MOST_FITTED, HASHED, LEAST_SCORE = 8000, 512, 0.5
#: Words whose codes a task remembers, and their length in bytes: about 10 MB.
_CACHED, _CACHED_LENGTH = 1 << 16, 32

#: Frequent function words of English, German, French and Spanish.
STOPWORDS = frozenset(
    "the of and to in is that for it as was with be by on are this from at an or not have but "
    "der die das und ist nicht mit von zu den im ein eine auf für sich dem des als auch an es "
    "le la les de des et un une est que pour dans qui sur pas par au du en plus ne se "
    "el los las y que en un una por con no para del se es al lo como su".split()
)
#: What a labeller looks at: (statistic, accept below or above, reject beyond). A text between the two gets no vote.
LABELLERS = (
    ("symbols", "below", 0.01, 0.04),
    ("capitals", "below", 0.15, 0.5),
    ("same_as_last", "below", 0.03, 0.15),
    ("variety", "above", 0.6, 0.35),
    ("shouting", "below", 0.05, 0.25),
    ("bare_marks", "below", 0.05, 0.2),
    ("stopwords", "above", 0.08, 0.03),
    ("marked_words", "below", 0.1, 0.4),
)
STATISTICS = tuple(x[0] for x in LABELLERS)
N_STATS = len(LABELLERS)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~|<>=_{}[]\\"]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_WINDOW = 50
_RUN, _POINTS = re.compile(rb"(.)\1+", re.DOTALL), b".,;:!?\"'()"
_STOP = frozenset(w.encode() for w in STOPWORDS)
_LONGEST = max(map(len, _STOP))


class Reader:
    """Statistics and hashed shapes of texts; remembers those of words, a bounded number of them."""

    def __init__(self, hashed: int = HASHED):
        self.hashed, self.known = hashed, {}

    def _word(self, w: bytes) -> int:
        """The word as one number: bits 0-3 stopword, shouted, without letters, wrapped in marks; above them its shape's hash."""
        shape = w.translate(_SHAPE)
        short = _RUN.sub(rb"\1", shape)
        capitals = shape.count(b"A")
        letters = capitals + shape.count(b"a")
        bare = w.strip(_POINTS)
        stop = len(bare) <= _LONGEST and bare.lower() in _STOP
        shout = w.endswith(b"!!") or letters > 1 and capitals == letters
        marks = not letters and b"0" not in shape
        wrapped = letters > 0 and bare.strip(b"-") != w.strip(_POINTS + b"-#$%&*@^~|<>=_")
        return (xxhash.xxh32_intdigest(short) % self.hashed) << 4 | stop | shout << 1 | marks << 2 | wrapped << 3

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(statistics, hashed frequencies) of a UTF-8 text; None without words."""
        words = (text or b"").split()
        if not words:
            return None
        n, known = len(words), self.known
        codes = list(map(known.get, words))
        if None in codes:
            for k, c in enumerate(codes):
                if c is None:
                    w = words[k]
                    codes[k] = own = self._word(w)
                    if len(w) <= _CACHED_LENGTH:
                        if len(known) >= _CACHED:
                            known.clear()
                        known[w] = own
        codes = np.array(codes, dtype=np.int64)
        count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        letters = max(1, int(count[_LETTER].sum()))
        same = sum(map(eq, words[1:], words))
        # distinct words of each run of 50, weighted by its length: whole texts of any length compare
        distinct = sum(len(set(words[k : k + _WINDOW])) for k in range(0, n, _WINDOW))
        stop, shout, marks, wrapped = (int((codes >> k & 1).sum()) / n for k in range(4))
        stats = np.array([count[_SYMBOLS].sum() / len(text), count[_CAPITAL].sum() / letters, same / n, distinct / n, shout, marks, stop, wrapped])
        return stats, np.bincount(codes >> 4, minlength=self.hashed) / n


def votes(stats: np.ndarray | None) -> list[int]:
    """1 accept, -1 reject, 0 abstain; texts without words are rejected by all."""
    if stats is None:
        return [-1] * len(LABELLERS)
    out = []
    for x, (_, side, good, bad) in zip(stats.tolist(), LABELLERS, strict=True):
        good_, bad_ = (x <= good, x >= bad) if side == "below" else (x >= good, x <= bad)
        out.append(1 if good_ else -1 if bad_ else 0)
    return out


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior that a pattern is good, share of good, accuracies[labeller, class, vote]) of votes -1, 0, 1.

    Starts from the share of accepting votes, so that class 1 is what most labellers accept. One pseudo-count a cell.
    """
    one = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeller, vote
    # a reject is rare and says more than an accept: any two of them make a text suspect at the start
    good = np.where((patterns == -1).sum(axis=1) >= 2, 0.1, 0.9)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        cell = np.einsum("cp,plv->lcv", weight, one) + 1.0
        cell /= cell.sum(axis=2, keepdims=True)
        log = np.einsum("plv,lcv->cp", one, np.log(cell)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return good, float(share), cell


class Model:
    """Weights and bias of the scorer; what the labellers gave: posteriors by pattern, the share of good texts, accuracies."""

    def __init__(self, weights: np.ndarray, bias: float, posterior: dict[int, float], share: float, accuracies: np.ndarray | None):
        self.weights, self.bias, self.posterior, self.share, self.accuracies = weights, bias, posterior, share, accuracies

    def scores(self, reads: pa.Array) -> np.ndarray:
        """Of texts as read by reading(); 0 for texts without words."""
        out = np.zeros(len(reads))
        for k, x in enumerate(reads.field("x")):
            if x.is_valid:
                stats, at, freq = _unpacked(x.as_buffer())
                z = self.weights[:N_STATS] @ np.minimum(stats, 1.0) + self.weights[N_STATS + at] @ np.sqrt(freq) + self.bias
                out[k] = 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))
        return out


#: A read text: the pattern of its votes in base 3, and its statistics and hashed frequencies, packed; null without words.
READ = pa.struct([("pattern", pa.int32()), ("x", pa.binary())])


def pattern_of(own: list[int]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(own))


def pattern_votes(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 - 1 for k in range(N_STATS)]


def _packed(stats: np.ndarray, shapes: np.ndarray) -> bytes:
    at = np.flatnonzero(shapes)
    return stats.astype("<f8").tobytes() + shapes[at].astype("<f4").tobytes() + at.astype("<u2").tobytes()


def _unpacked(x: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, places, frequencies there)."""
    n = (len(x) - 8 * N_STATS) // 6
    return (np.frombuffer(x, "<f8", N_STATS), np.frombuffer(x, "<u2", n, 8 * N_STATS + 4 * n).astype(np.int64), np.frombuffer(x, "<f4", n, 8 * N_STATS))


def reading(text: Column) -> Column:
    """The text as read, a struct of READ. Only the text goes to Python, other columns stay where they are."""

    @F.arrow_udf("struct<pattern:int,x:binary>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for batch in batches:
            patterns, xs = [], []
            for t in batch:
                r = reader(t.as_py())
                patterns.append(pattern_of(votes(r[0] if r else None)))
                xs.append(_packed(*r) if r else None)
            yield pa.StructArray.from_arrays([pa.array(patterns, pa.int32()), pa.array(xs, pa.binary())], fields=list(READ))

    return read(text.cast("binary"))


def _linear(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam, full batch."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], dtype=np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -60, 60))) - y).astype(np.float32) / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(float), float(w[-1])


def _sample(reads: DataFrame, most: int, seed: int) -> DataFrame:
    """(pattern, x) of `most` documents with words at most, the first by hash of doc_id; of rows with one doc_id, the least x."""
    worded = reads.where("doc_id is not null and x is not null")
    ids = worded.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    # at most `most` ids
    own = worded.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "pattern")).alias("_r"))
    return own.select("_r.pattern", "_r.x")


def train(reads: DataFrame, most_fitted: int = MOST_FITTED, seed: int = 42) -> Model:
    """reads: (doc_id, pattern, x) of all documents. Their votes give the posterior labels; those of a bounded sample train the scorer."""
    # 3 ** 8 patterns at most
    found = sorted((r["pattern"], r["count"]) for r in reads.groupBy("pattern").count().collect())
    none = np.zeros(N_STATS + HASHED)
    if not found:
        return Model(none, 0.0, {}, 1.0, None)
    good, share, accuracies = em(np.array([pattern_votes(p) for p, _ in found]), np.array([n for _, n in found], dtype=float))
    posterior = {p: float(g) for (p, _), g in zip(found, good, strict=True)}
    # sorted, as the sample arrives in any order; packed, it takes under 4 kB a document
    rows = sorted((bytes(r["x"]), r["pattern"]) for r in _sample(reads, most_fitted, seed).collect())
    if not rows:
        return Model(none, 0.0, posterior, share, accuracies)
    x, y = np.zeros((len(rows), N_STATS + HASHED), dtype=np.float32), np.array([posterior[p] for _, p in rows])
    for k, (packed, _) in enumerate(rows):
        stats, at, freq = _unpacked(pa.py_buffer(packed))
        x[k, :N_STATS] = np.minimum(stats, 1.0)
        x[k, N_STATS + at] = np.sqrt(freq)
    return Model(*_linear(x, y), posterior, share, accuracies)


def scoring(model: Model, read: Column) -> Column:
    """The score of a read text, 0 to 1, 1: good."""

    @F.arrow_udf("double")
    def score(reads: pa.Array) -> pa.Array:
        return pa.array(model.scores(reads), pa.float64())

    return score(read)


def _trained(rows: DataFrame, read: str) -> Model:
    return train(rows.select("doc_id", F.col(f"{read}.pattern").alias("pattern"), F.col(f"{read}.x").alias("x")))


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns whatever their names. The rows are written once beside what was read of
    their texts, so the texts go through Python once and nothing is joined."""
    name = free_name(docs, "_read")
    rows = materialise(docs.withColumn(name, reading(F.col("text"))))
    return rows.where(scoring(_trained(rows, name), F.col(name)) >= least).select(*all_of(docs))


def op8_quality(docs: DataFrame) -> DataFrame:
    """doc_id, score, kept of all documents."""
    rows = materialise(docs.select("doc_id", reading(F.col("text")).alias("_read")))
    scored = rows.select("doc_id", scoring(_trained(rows, "_read"), F.col("_read")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= LEAST_SCORE).alias("kept"))
