"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), in numpy.

A text is the set of its words and of their first 4, 5 and 6 letters, hashed. From confirmed toxic texts (P) and unlabelled text
(U) the features that P has far more often than U are chosen, then a logistic classifier is fitted to the class-prior-corrected
risk prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1)); where the bracket is negative, its gradient is reversed, as published.

Fitting reads at most MOST_TOXIC confirmed toxic texts and MOST_UNLABELLED others, chosen by hash of doc_id, and the
classifier takes the FEATURES of most gain (a word has up to four). These are the only bounds: every text is scored whole. Labels of held-out rows are never read; lang, source and doc_id aren't features.

Defined results: null and empty texts have no features and get the score of the bias; repeated rows are scored each; null
doc_ids are scored, held out if the CRC of the empty text says so, and never used as labels; without a confirmed toxic text every
score is 0; an empty table gives no rows; labels of null value or unknown doc_id are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOXIC, MOST_UNLABELLED = 4000, 8000
FEATURES, HASHED, LEAST_GAIN = 512, 1 << 20, 12.0
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_CACHED = 400_000


def features(word: str) -> tuple[int, ...]:
    """Hashed: the word, and its first 4, 5 and 6 letters."""
    forms = {"=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)}
    return tuple(xxhash.xxh32_intdigest(f) % HASHED for f in forms)


class Hasher:
    """Distinct features of texts; remembers those of words, a bounded number of them."""

    def __init__(self, only: dict[int, int] | None = None):
        self.only, self.known = only, {}

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        known = self.known
        for w in set(_WORD.findall((text or "").lower())):
            own = known.get(w)
            if own is None:
                if len(known) >= _CACHED:
                    known.clear()
                own = features(w)
                if self.only is not None:
                    own = tuple(self.only[f] for f in own if f in self.only)
                known[w] = own
            if own:
                found.update(own)
        return found


class Model:
    """Chosen features with their weights, and a bias."""

    def __init__(self, place: dict[int, int], weights: np.ndarray, bias: float, prior: float):
        self.place, self.weights, self.bias, self.prior = place, weights, bias, prior

    def score(self, found: set[int]) -> float:
        z = self.bias + float(sum(self.weights[k] for k in found))
        return 1.0 / (1.0 + float(np.exp(-max(-60.0, min(60.0, z)))))


def _dense(texts: list[np.ndarray], chosen: list[int]) -> np.ndarray:
    place = np.full(HASHED, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), dtype=np.float32)
    for r, found in enumerate(texts):
        at = place[found]
        x[r, at[at >= 0]] = 1.0
    return x


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 250, rate: float = 0.05, l2: float = 3e-4) -> Model | None:
    """positive, unlabelled: distinct hashed features of texts, as arrays. None without positives."""
    if not positive:
        return None
    unlabelled = unlabelled or positive
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = np.zeros(HASHED, dtype=np.int32), np.zeros(HASHED, dtype=np.int32)
    for count, texts in ((in_p, positive), (in_u, unlabelled)):
        for found in texts:
            count[found] += 1
    # likelihood ratio of "as frequent in P as seen" against "as frequent as in U"; below LEAST_GAIN chance explains it
    p, u = in_p / n_p, (in_u + 1.0) / (n_u + 1.0)
    gain = np.where((in_p >= 3) & (p > 2 * u), in_p * np.log(np.maximum(p, 1e-12) / u), 0.0)
    gain[gain < LEAST_GAIN] = 0.0
    chosen = [int(f) for f in np.argsort(-gain, kind="stable")[:FEATURES] if gain[f] > 0]
    place = {f: k for k, f in enumerate(chosen)}
    x_p, x_u = _dense(positive, chosen), _dense(unlabelled, chosen)
    w, b = np.zeros(len(place), dtype=np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(place) + 1, dtype=np.float32), np.zeros(len(place) + 1, dtype=np.float32)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
    softplus = lambda z: np.logaddexp(0.0, z)
    for t in range(1, steps + 1):
        z_p, z_u = x_p @ w + np.float32(b), x_u @ w + np.float32(b)
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        # logistic losses: R_P(+1) of softplus(-z), R(-1) of softplus(z)
        d_pos = np.append(x_p.T @ (s_p - 1), (s_p - 1).sum()) / n_p
        d_neg = np.append(x_u.T @ s_u, s_u.sum()) / n_u - prior * np.append(x_p.T @ s_p, s_p.sum()) / n_p
        bracket = softplus(z_u).mean() - prior * softplus(z_p).mean()
        g = prior * d_pos + d_neg if bracket >= 0 else -d_neg
        g = g + np.append(l2 * w, 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        w, b = w - step[:-1], b - float(step[-1])
    return Model(place, w.astype(np.float64), b, prior)


def _remainder(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED, seed: int = 42) -> Model | None:
    """Fits on confirmed toxic rows of labels(doc_id, toxic) outside the held-out fold, and on unlabelled text of docs."""
    open_ = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_remainder("doc_id") != 2))
    prior = open_.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    prior = float(min(0.9, max(0.01, prior)))
    order = F.xxhash64("doc_id", F.lit(seed))
    toxic = open_.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_toxic).withColumn("_p", F.lit(True))
    others = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(most_unlabelled).withColumn("_u", F.lit(True))
    # most_toxic + most_unlabelled ids at most
    wanted = toxic.join(others, "doc_id", "full").select(F.col("doc_id").alias("_id"), F.coalesce("_p", F.lit(False)).alias("_p"), F.coalesce("_u", F.lit(False)).alias("_u"))
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).select("doc_id", "_p", "_u", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [np.array(sorted(hasher(t.as_py())), dtype=np.int32).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["doc_id", "_p", "_u", "f"])

    rows = texts.mapInArrow(run, "doc_id long, _p boolean, _u boolean, f binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    sets = [np.frombuffer(f, dtype=np.int32) for f in rows["f"]]
    return fit([s for s, p in zip(sets, rows["_p"], strict=True) if p], [s for s, u in zip(sets, rows["_u"], strict=True) if u], prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(model.place if model else {})
        for batch in batches:
            scores = [model.score(hasher(t.as_py())) if model else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (_remainder("doc_id") == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
