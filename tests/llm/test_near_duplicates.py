import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mirador.llm import embeddings, linededup, simhash, substring
from mirador.llm.blocks import forest, linked
from mirador.llm.graph import components


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def slow_fingerprint(text):
    words = (text or "").translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(400, pairs)
    assert all(found.get(k, k) == want[k] for k in range(400))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_and_blocks(spark):
    assert forest(5, np.array([3, 1]), np.array([4, 3])) == [(3, 1), (4, 1)]
    near = lambda x, y, same: tuple(np.array(v, dtype=int) for v in zip(*[(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if abs(a - b) == 1 and (not same or i < j)], strict=True)) if any(abs(a - b) == 1 for a in x for b in y) else (np.empty(0, int), np.empty(0, int))
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, k) for k in range(60, 100, 2)], "key long, node long")
    edges = linked(rows, "key", "node", near, block=7).collect()
    assert len(set(roots(100, [(e["a"], e["b"]) for e in edges])[:50])) == 1 and all(e["a"] < 50 for e in edges)


def test_simhash(docs, rows):
    found = simhash.op7_simhash(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in found) == sorted((str(r[0]), f"{slow_fingerprint(r[1]):016x}") for r in rows)
    prints = [int(r["fingerprint"], 16) for r in found]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    own = roots(len(prints), pairs)
    for k, r in enumerate(found):
        ids = [found[j]["doc_id"] for j in range(len(found)) if own[j] == own[k] and found[j]["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)


def test_simhash_links_by_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << x for x in rng.sample(range(64), k % 6)) for k, b in enumerate(base)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = simhash._keyed(spark.createDataFrame([(signed(x),) for x in set(fps)], "_fp long"), np.arange(2048))
    edges = linked(keyed, "_key", "_fp", simhash._close, block=8).collect()
    at = {signed(x): k for k, x in enumerate(fps)}
    want = roots(80, [(i, j) for i in range(80) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = roots(80, [(at[e["a"]], at[e["b"]]) for e in edges] + [(i, at[signed(x)]) for i, x in enumerate(fps)])
    assert want == got


def test_one_of_each_stays(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [slow_fingerprint(r[1]) for r in rows]
    own = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    first = {}
    for k, r in enumerate(rows):
        first.setdefault(own[k], []).append((r[0] is None, r[0] or 0))
    want = sorted(min(v) for v in first.values())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want


def test_rows_of_one_id_and_unlike_texts_both_stay(spark):
    rng = random.Random(17)
    some = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))
    a, b, c = some(), some(), some()
    names = ["doc_id", "text", "_rid", "__rid", "a.b", "_fp", "_class", "component_id", "doc_id_"]
    rows = [(5, a), (5, b), (5, a), (7, b), (None, a), (None, c), (None, c)]
    df = spark.createDataFrame([(*r, *[1] * 7) for r in rows], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names)).repartition(3)
    kept = simhash.one_of_each(df)
    assert kept.columns == names
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("5", a), ("5", b), ("None", c)])


def test_empty(spark, empty):
    assert simhash.op7_simhash(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert substring.op3_substring_dedup(empty).count() == 0 and linededup.op10_line_dedup(empty).count() == 0
    assert embeddings.op5_embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[:40] + rng.normal(size=(40, 16)).astype(np.float32) * rng.uniform(0, 0.5, (40, 1)).astype(np.float32)
    x[100:120] = x[7]
    x[120] = 3 * x[7]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [None] + [1.0] * 15, 0), (404, [float("nan")] * 16, 0), (405, [float("inf")] * 16, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (None, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df, tile=64, tile_bytes=16 * 8 * 50).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T >= 0.9
    own = roots(300, list(zip(*np.nonzero(s), strict=True)))
    assert len(found) == 309
    for k in range(300):
        assert found[k]["n_links"] == s[k].sum() - 1 and found[k]["component_id"] == own[k] and found[k]["kept"] == (own[k] == k)
    assert all(found[k]["n_links"] == 0 and found[k]["component_id"] == k for k in range(400, 406))
    assert found[406]["n_links"] == 1 and found[407]["component_id"] == 406
    assert found[None]["n_links"] == 0 and found[None]["component_id"] is None


def slow_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    key = lambda line: line.strip(strip).translate(lower)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(d)
    lost = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (key(x) in lost and lost[key(x)] != d)]
        out.append((str(d), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_both_ways(docs, rows):
    want = slow_lines([r[:2] for r in rows])
    assert sum(r[2] for r in want) == 5
    for keys in (0, 1000):
        found = linededup.drop_lines(docs, lookup_keys=keys, digest=True).collect()
        assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in found) == want


def test_line_runs_compact_and_hold_the_largest(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    rows = [(k % 13, 0, d) for d in range(40, 0, -1) for k in range(d % 7 + 1)]
    for lo, hi in ((31, 41), (21, 31), (11, 21), (1, 11)):
        runs.add(spark.createDataFrame([r for r in rows if lo <= r[2] < hi], "k1 long, k2 long, doc_id long").distinct())
    want = {}
    for k, _, d in rows:
        want.setdefault(k, set()).add(d)
    found = runs.all().collect()
    assert len(runs.levels) == 3 and not runs.levels[0] and not runs.levels[1]
    assert {r["k1"]: (r["n_docs"], r["holder"]) for r in found} == {k: (len(v), max(v)) for k, v in want.items()}


def test_substring(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = some(51)
    docs = {k: some(rng.randint(0, 200)) for k in range(40)}
    planted = {3, 17, 31}
    for d in planted:
        at = rng.randint(0, len(docs[d]))
        docs[d][at:at] = passage
    near = some(120)
    changed = list(near)
    changed[60] = "changed"
    rows = [(d, " ".join(w).replace("w7", "W7")) for d, w in docs.items()]
    # the same words on other lines; a line of which a word was changed; a passage of 20 words isn't one
    rows = [(d, t.replace(" ", "\n", 30) if d == 17 else t) for d, t in rows] + [(50, " ".join(near[:60])), (51, " ".join([*near[:29], "other", *near[30:60]]))]
    rows += [(60, " ".join(some(40) + near[100:120])), (61, " ".join(near[100:120] + some(40))), (62, None), (63, ""), (None, " ".join(passage)), (3, rows[3][1])]
    found = substring.documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    repeated = {d for d, r in got.items() if r["n_repeats"]}
    assert repeated == planted | {50, 51}
    assert {got[d]["component_id"] for d in planted} == {3} and got[3]["n_removed"] == 0 and got[3]["n_repeats"] == 1
    assert all(got[d]["words_removed"] == 51 and got[d]["n_removed"] == 1 for d in planted - {3})
    assert got[51]["component_id"] == 50 and got[51]["words_removed"] == 60 and got[50]["words_removed"] == 0
    assert all(got[d]["component_id"] == d for d in got if d not in repeated)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]


def test_near_lines_by_jaccard(spark):
    rng = random.Random(2)
    line = [f"x{rng.randrange(5000)}" for _ in range(140)]
    other = [*line[:70], "new", *line[71:]]  # 5 of 136 shingles differ
    far = [w if k % 9 else f"y{k}" for k, w in enumerate(line)]
    df = spark.createDataFrame([(1, " ".join(line[:140])), (2, " ".join(other)), (3, " ".join(far))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in substring.op3_substring_dedup(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_removed_passages_are_whole(spark):
    rng = random.Random(21)
    some = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    docs, want = {k: some(30) for k in range(40)}, {}
    for k in range(0, 40, 2):
        passage = some(51 + 4 * k)
        docs[k][11:11] = passage
        docs[k + 1][17:17] = passage
        want[k + 1] = [(17, 17 + len(passage))]
    # ends that a document shares with another than the first
    long_ = some(90)
    for d, part in ((50, long_[15:70]), (51, long_), (52, long_)):
        docs[d] = some(9) + part + some(9)
    want |= {51: [(9 + 15, 9 + 70)], 52: [(9, 99)]}
    rows = [(d, "\n".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7))) for d, w in docs.items()]
    found = {r["doc_id"]: r for r in substring.documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: [tuple(s) for s in r["removed"]] for d, r in found.items() if r["removed"]} == want
    assert all(found[d]["words_removed"] == sum(b - a for a, b in s) for d, s in want.items())


def test_runs_are_those_of_brute_force(spark):
    """Every document's removed ranges against all runs of 51 words, over few words, so that runs overlap and meet in many ways."""
    rng = random.Random(41)
    pieces = [[f"p{rng.randrange(4000)}" for _ in range(n)] for n in (20, 35, 52, 60, 75, 110)]
    docs = {}
    for d in range(50):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choice(pieces) if rng.random() < 0.6 else [f"q{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))]
        docs[d] = w
    n = substring.LEAST_WORDS
    first = {}
    for d in sorted(docs):
        for k in range(len(docs[d]) - n + 1):
            first.setdefault(tuple(docs[d][k : k + n]), d)
    # one line each with unlike neighbours, so that no paragraph is similar: blank lines everywhere
    rows = [(d, "\n\n".join(" ".join(w[k : k + 20]) for k in range(0, len(w), 20))) for d, w in docs.items()]
    found = {r["doc_id"]: r for r in substring.documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    some = 0
    for d, w in docs.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                gone |= set(range(k, k + n))
        some += len(gone)
        assert {x for a, b in found[d]["removed"] for x in range(a, b)} == gone and found[d]["words_removed"] == len(gone)
    assert some > 1000


def test_wrapped_paragraphs_with_an_edit(spark):
    """Copies wrapped at other places and changed in one word, so that no 32 words in a row are unchanged: found as blocks."""
    rng = random.Random(43)
    rows, near = [], 0
    for k in range(40):
        w = [f"z{rng.randrange(10**6)}" for _ in range(60)]
        other = [*w[:30], "changed", *w[31:]]
        wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
        lead = " ".join(f"y{rng.randrange(10**6)}" for _ in range(20))
        rows += [(2 * k, f"{lead}\n\n{wrap(w, 11)}\n \nend"), (2 * k + 1, wrap(other, 7))]
    found = {r["doc_id"]: r for r in substring.documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = sum(found[2 * k + 1]["component_id"] == 2 * k and found[2 * k + 1]["words_removed"] == 60 for k in range(40))
    assert near >= 38 and all(found[2 * k]["words_removed"] == 0 for k in range(40))


def test_paragraphs_of_lines_and_blocks():
    n = substring.LEAST_WORDS
    assert list(substring._blocks([n, 0, 30, 30, 0, 10, 0, n + 5, 3])) == [(0, n), (n, n + 60), (n + 70, 2 * n + 75)]
    assert list(substring._blocks([3, n, 20, 40, n + 1])) == [(3, n + 3), (n + 3, n + 63), (n + 63, 2 * n + 64)]
    assert list(substring._blocks([])) == [] and list(substring._blocks([n - 1])) == []
    assert substring.merged(np.array([5, 1, 9, 20]), np.array([9, 3, 12, 21])) == [{"word_from": 1, "word_to": 3}, {"word_from": 5, "word_to": 12}, {"word_from": 20, "word_to": 21}]


def test_one_of_each_by_row(spark):
    rng = random.Random(13)
    some = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d = some(), some(), some(), some()
    # copies without an id of a document with one; a class without ids; an id whose one text is a copy and the other isn't
    rows = [(1, a), (None, a), (None, a), (None, b), (None, b), (None, c), (5, a), (5, d), (5, a)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("1", a), ("None", b), ("None", c), ("5", d)])


def test_words_are_hashed_alike_wherever_they_stand():
    long = b"x" * 100_000
    texts = [b"", b" \t\n\x0b", b"A b\nc\n\n a\x00\x0c\xc3\xa9 ", long + b" y\n" + b"z " * 40_000, b"w " * 40_000 + long, b"a\n" * 40_000]
    of_word, of_hash = {}, {}
    for text in texts:
        hashes, sizes = substring.words_of(text)
        lines = [line.split() for line in text.lower().split(b"\n")]
        assert sizes.tolist() == [len(line) for line in lines]
        for word, h in zip([w for line in lines for w in line], hashes.tolist(), strict=True):
            assert of_word.setdefault(word, h) == h and of_hash.setdefault(h, word) == word


def test_winnowing_takes_the_last_of_the_least():
    h = np.random.default_rng(5).integers(0, 6, 300, dtype=np.uint64)
    for of in (1, 2, 7, 20):
        assert substring.winnowed(h, of).tolist() == [max(j for j in range(i, i + of) if h[j] == h[i : i + of].min()) for i in range(300 - of + 1)]
    assert not len(substring.winnowed(h[:5], 6))
