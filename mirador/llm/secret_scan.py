r"""Secret scans through an inverted trigram index, in DataFrame operations only.

Each rule is a regular expression. Its Boolean trigram query is derived when the plan is made: alternatives, each of trigrams that
must all occur. One scan of all texts gives the index, a posting (trigram, document) for each trigram that some query asks for.
Postings are intersected, shortest lists first: the documents in the list of some alternative's rarest trigram are taken, their
postings are joined with the queries, and a document is a rule's candidate if it has all postings of an alternative. Only the
candidates' texts are scanned with the rule's regex. Rules without mandatory trigrams scan all texts, in the first scan.

Spans: the regex is replaced by itself between marks, the text is split at the marks, and lengths before give the places;
a mark is a private-use character, which is swapped for another of its kind in the text first, so that no place moves. The work grows
with the length of the text: sums are taken in chunks of parts, and no rule tries a run of letters again from each of its places.

Defined results: a null text is an empty one; repeated rows and repeated or null doc_ids are documents of their own, as are
all rows; an empty table gives no rows. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import materialise
from mirador.llm.trigrams import trigram_query


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int  # code points that the counted group must have
    group: int  # the counted group
    base: bool = False
    inner: str = ""  # what counts of a match, from its start; matches without it don't


#: The contract's three kinds, then those that this scan adds. Patterns mean the same in Java and RE2.
#: Runs of one class are asked for in their least length, which finds the same runs as filtering afterwards.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18, 0, True),
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0),
    # whole runs first: a run of many eyJ without dots is read once
    Rule("jwt", r"[A-Za-z0-9_.-]{40,}", 40, 0, inner=r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0),
)
_SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"
MARK, OTHER = "\ue000", "\ue001"
#: Parts whose spans are gathered in one go.
CHUNK = 128


def _none() -> Column:
    return F.array().cast(_SPANS)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: a lambda works out again whatever it takes from outside, but not its argument."""
    return F.transform(F.array(value), then)[0]


def _spans(rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of a rule in _text, which has no MARK."""
    parts = F.split(F.regexp_replace("_text", rule.pattern, f"{MARK}$0{MARK}"), MARK)
    # in chunks, so that what grows by appending stays short; CHUNK is even, so every second part of a chunk is a match
    def chunked(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, CHUNK))
        return F.transform(chunks, lambda own: F.struct(own.alias("parts"), F.aggregate(own, F.lit(0), lambda n, part: n + F.length(part)).alias("n")))

    def starts(held: Column) -> Column:
        return F.aggregate(
            held, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda acc, own: F.struct((acc["at"] + own["n"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"],
        )

    def step(acc: Column, part: Column) -> Column:
        own = F.regexp_extract(part, rule.inner, 0) if rule.inner else part
        counted = F.length(F.regexp_extract(part, rule.pattern, rule.group)) if rule.group else F.length(own)
        one = F.struct(acc["at"].alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (acc["at"] + F.length(own)).alias("end"))
        spans = F.when(acc["match"] & (counted >= rule.least), F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(part)).alias("at"), (~acc["match"]).alias("match"), spans.alias("spans"))

    def in_chunk(own: Column, at: Column) -> Column:
        # (where the next part begins, whether it is a match, spans so far)
        return F.aggregate(own["parts"], F.struct(at.alias("at"), F.lit(False).alias("match"), _none().alias("spans")), step, lambda acc: acc["spans"])

    found = _let(parts, lambda all_: _let(chunked(all_), lambda held: F.flatten(F.zip_with(held, starts(held), in_chunk))))
    return F.when(F.col("_text").rlike(rule.pattern), found).otherwise(_none())


def asked(rules: tuple[Rule, ...]) -> list[tuple[int, int, int, str]]:
    """(rule, alternative, bit, trigram) of all rules with mandatory trigrams."""
    out = []
    for k, rule in enumerate(rules):
        query = trigram_query(rule.inner or rule.pattern)
        if query is not True:
            out += [(k, a, bit, gram) for a, grams in enumerate(sorted(query, key=sorted)) for bit, gram in enumerate(sorted(grams))]
    return out


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text) as doc_id and spans: array<struct<start, place, kind, end>> by start, then kind as in rules."""
    # a document of the index: doc_id and text; rows that repeat both have the same spans
    rows = docs.select("doc_id", F.col("text").alias("_raw"), F.translate(F.coalesce("text", F.lit("")), MARK, OTHER).alias("_text"))
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_hash", F.xxhash64("_text"))
    key = ["_id", "_hash"]
    queries = asked(rules)
    indexed = sorted({k for k, *_ in queries})
    grams = sorted({q[3] for q in queries})

    # one scan of all texts: what the rules without trigrams find, and which of the asked trigrams occur
    full = [_spans(r, k) for k, r in enumerate(rules) if k not in indexed]
    scanned = rows.withColumn("_low", F.lower("_text")).select(
        "doc_id", *key, F.flatten(F.array(_none(), *full)).alias("_full"),
        F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams])).alias("_grams"),
    )
    scanned = materialise(scanned)
    if not queries:
        return scanned.select("doc_id", F.array_sort("_full").alias("spans"))

    # the index, and how long the list of each trigram is: as many rows as there are trigrams
    postings = scanned.select(F.explode("_grams").alias("gram"), *key)
    long_ = {r["gram"]: r["count"] for r in postings.groupBy("gram").count().collect()}
    rarest = {min((long_.get(g, 0), g) for k_, a_, _, g in queries if (k_, a_) == (k, a))[1] for k, a, *_ in queries}
    first = materialise(postings.where(F.col("gram").isin(*rarest)).select(*key).distinct())
    # the lists are intersected: as many rows of queries as the rules' patterns have
    whole = {(k, a): sum(1 << b for k_, a_, b, _ in queries if (k_, a_) == (k, a)) for k, a, *_ in queries}
    query = docs.sparkSession.createDataFrame([(k, a, 1 << b, whole[k, a], g) for k, a, b, g in queries], "_rule int, _alternative int, _bit long, _whole long, gram string")
    met = postings.join(first, key, "left_semi").join(F.broadcast(query), "gram")
    met = met.groupBy(*key, "_rule", "_alternative").agg(F.bit_or("_bit").alias("_have"), F.first("_whole").alias("_whole")).where("_have = _whole")
    candidates = materialise(met.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, _rule)")).alias("_rules")))

    # texts without any of the rarest trigrams can't be candidates: they aren't moved. One expression, so that a text is folded once
    near = rows.where(F.lower("_raw").rlike("|".join(re.escape(g) for g in sorted(rarest))))
    texts = near.select(*key, "_text").join(candidates, key)
    looked = [F.when(F.col("_rules").bitwiseAND(F.lit(1 << k)) != 0, _spans(rules[k], k)).otherwise(_none()) for k in indexed]
    checked = texts.select(*key, F.flatten(F.array(_none(), *looked)).alias("_found")).where("size(_found) > 0")
    checked = materialise(checked.dropDuplicates(key))
    both = scanned.select("doc_id", *key, "_full").join(checked, key, "left")
    return both.select("doc_id", F.array_sort(F.concat("_full", F.coalesce("_found", _none()))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of all documents."""
    base = [r.kind for r in RULES if r.base]
    found = secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = _joined(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(own.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _duck(rule: Rule, place: int) -> str:
    """Rows (doc_id, place, kind, start, end) of a rule, the same way: marks, split, lengths before."""
    pattern = rule.pattern.replace("'", "''")
    own = f"regexp_extract(part, '{rule.inner}')" if rule.inner else "part"
    counted = f"length(regexp_extract(part, '{pattern}', {rule.group}))" if rule.group else f"length({own})"
    return f"""
    SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, upto - length(part) AS start, upto - length(part) + length({own}) AS stop FROM (
      SELECT doc_id, pos, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM (
        SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (
          SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS parts FROM texts)))
    WHERE pos % 2 = 0 AND {counted} >= {rule.least}"""


def _op2_sql() -> str:
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    one = "kind || ':' || start || ':' || stop"
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344), chr(57345)) AS text FROM documents),
spans AS ({" UNION ALL ".join(_duck(r, k) for k, r in enumerate(RULES))})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({one}, ',' ORDER BY start, place) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY start, place), '') AS spans
FROM texts d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


OP2_SQL = _op2_sql()
