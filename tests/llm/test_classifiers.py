import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mirador.llm import quality, toxicity
from mirador.llm.registry import oracle_sql, queries


def corpus(spark, n=600):
    rng = random.Random(1)
    plain = [f"wort{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        words = [rng.choice(plain) for _ in range(60)]
        if toxic:
            for at in rng.sample(range(60), 4):
                words[at] = rng.choice(["vile", "scumbag", "scumming", "nasty"])
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "vile scumbag", "en", "s", 0), (0, rows[0][1], "en", "s", 1)]
    labels += [(n + 9, 1, 1), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_repeated_rows_leave_the_toxicity_sample_whole(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior: sizes.append((len(positive), len(unlabelled))))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)] + [(k, f"text {k}") for k in range(20)] * 9, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(20)], "doc_id long, toxic int")
    toxicity.train(docs, labels, most_toxic=4, most_unlabelled=12)
    assert sizes == [(4, 12)]


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = corpus(spark)
    found = toxicity.op6_toxicity(docs, labels).collect()
    assert len(found) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    named = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in named)
    held = [r for r in named if r["held_out"]]
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert right / len(held) > 0.95


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(spark, 200)
    score = lambda lab: sorted((str(r["doc_id"]), r["score"]) for r in toxicity.op6_toxicity(docs, lab).collect())
    flipped = labels.withColumn("toxic", (toxicity._remainder("doc_id") == 2).cast("int") * (1 - labels["toxic"]) + (toxicity._remainder("doc_id") != 2).cast("int") * labels["toxic"])
    assert score(labels) == score(flipped)


def test_risk_is_kept_non_negative():
    model = toxicity.fit([np.array([1, 2])] * 8 + [np.array([1, 3])] * 8, [np.array([k + 10]) for k in range(64)] + [np.array([1])] * 4, 0.1)
    assert model.score({model.place[1]}) > 0.5 > model.score(set())
    assert toxicity.fit([], [np.array([1])], 0.1) is None


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(spark, 20)
    assert {r["score"] for r in toxicity.op6_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.op6_toxicity(docs.limit(0), labels).count() == 0
    assert quality.op8_quality(docs.limit(0)).count() == 0 and quality.accepted(docs.limit(0)).count() == 0


def junk(rng, k):
    words = ["river", "stone", "garden", "letter", "window", "market"]
    some = [rng.choice(words) + rng.choice("abcdefg") for _ in range(60)]
    return [" ".join(w.upper() + "!!" for w in some), " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in some), " ".join(w for w in some[:8] for _ in range(9)), " | ".join(w.title() for w in some)][k % 4]


def test_quality(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("river", "stone", "garden", "letter", "window", "market", "paper") for b in ("", "s", "ing", "ed", "er", "ly", "ish", "es")]
    good = [(k, " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else rng.choice(words) for _ in range(80)).capitalize() + ".") for k in range(200)]
    bad = [(1000 + k, junk(rng, k)) for k in range(40)]
    rows = good + bad + [(2000, None), (2001, " \n"), (None, good[0][1]), good[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    found = quality.op8_quality(df).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert len(kept & {k for k, _ in good}) >= 198 and len(kept & {k for k, _ in bad}) <= 2 and not kept & {2000, 2001}
    stay = quality.accepted(df)
    assert stay.columns == df.columns and {r["doc_id"] for r in stay.collect()} == kept


def test_em_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.5]
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, share, cells = quality.em(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05
    found = [(cells[k, 1, 2] + cells[k, 0, 0]) / 2 for k in range(4)]
    assert all(abs(f - a) < 0.07 for f, a in zip(found, accuracy, strict=True))


def test_registry():
    assert {q.split("_")[0] for q in queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())


def test_repeated_ids_leave_the_sample_whole(spark):
    first = spark.range(50).orderBy(F.xxhash64("id", F.lit(42)), "id").first()["id"]
    rows = [(k, f"text {k}") for k in range(50)] + [(first, f"copy {k}") for k in range(200)] + [(99, None), (None, "text")]
    reads = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", quality.reading(F.col("text")).alias("r")).select("doc_id", "text", "r.*")
    found = quality._sample(reads, 20, 42).collect()
    read = {(r["pattern"], bytes(r["x"])) for r in reads.where("x is not null").collect()}
    assert len(found) == 20 and {(r["pattern"], bytes(r["x"])) for r in found} <= read
    assert quality._sample(reads, 1000, 42).count() == 50


def test_texts_as_read_are_those_of_the_reader(spark):
    texts = ["The river and the stone.", "AA!! BB!! ## ##", None, "", " \n", "x " * 300, "é ü 12 " * 9]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", quality.reading(F.col("text")).alias("r")).collect()
    for r in got:
        want = quality.Reader()((texts[r["k"]] or "").encode())
        assert quality.pattern_votes(r["r"]["pattern"]) == quality.votes(want[0] if want else None)
        assert (r["r"]["x"] is None) == (want is None)
        if want:
            stats, at, freq = quality._unpacked(pa.py_buffer(bytes(r["r"]["x"])))
            dense = np.zeros(quality.HASHED)
            dense[at] = freq
            assert np.array_equal(stats, want[0]) and np.allclose(dense, want[1], atol=1e-7)


def test_quality_by_brute_force(spark):
    """Each score against a model fitted here on the same posteriors, in double precision and without batches."""
    rng = random.Random(5)
    words = ["the", "of", "river", "stones", "garden", "Letter", "window,", "market."]
    rows = [(k, " ".join(rng.choice(words) for _ in range(50)) if k % 4 else junk(rng, k // 4)) for k in range(120)]
    reader = quality.Reader()
    reads = [reader(t.encode()) for _, t in rows]
    own = [tuple(quality.votes(r[0])) for r in reads]
    kinds = sorted(set(own))
    good, share, _ = quality.em(np.array(kinds), np.array([own.count(k) for k in kinds], dtype=float))
    y = np.array([good[kinds.index(o)] for o in own])
    x = np.array([np.concatenate([np.minimum(s, 1), np.sqrt(h)]) for s, h in reads])
    w, b = quality._linear(x, y)
    want = {k: 1 / (1 + np.exp(-(x[n] @ w + b))) for n, (k, _) in enumerate(rows)}
    found = {r["doc_id"]: r["score"] for r in quality.op8_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(abs(found[k] - s) < 0.02 for k, s in want.items())
    assert 0.5 < share < 0.9


def test_clashing_names_pass_through(spark):
    names = ["doc_id", "text", "_read", "_READ_", "a.b", "score", "_bytes", "_score", "_rid", "x"]
    df = spark.createDataFrame([(k, f"The river of stones and the garden {k}.", *"abcdefgh") for k in range(9)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = quality.accepted(df)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
