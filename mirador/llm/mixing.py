"""Mixing sources to target weights, in DataFrame operations only.

The words of each source, its documents in a pseudorandom order, are packed into blocks of fixed length. The mix is a
row of output shards, each of a fixed number of slots. Every slot draws its source, so a shard's counts by source are
multinomial; the few draws by which a source ends above its target are dealt to those that end below. The j-th slot of
a source takes block perm(j mod blocks), where perm is a pseudorandom permutation of that pass over the source, and
slots and blocks are joined by index. The last slot of a source is cut so that the target is met to the word.

Defined results: a null text has no words; null is a source of its own, after all others; documents without words take
part with 0; repeated rows and repeated or null doc_ids are documents of their own; an empty table gives an empty mix.
Columns of the input other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.common import all_of, free_name, materialise, n_words, running_start, with_row_id

#: Cells that the draw of a source is looked up in: the table of cells has this many rows at any input size.
CELLS = 65536
#: Documents that share one chunk when offsets are summed up.
CHUNK_ROWS = 5_000
ROUNDS = 12


class Mix(NamedTuple):
    """documents: _rid doc_id source size source_size target; slots: shard sid block take pass;
    pieces: shard, sid, block, pass, _rid and the words [word_from, word_from + n_words) that the slot takes of it."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def permuted(df: DataFrame, x: str, n: str, keys: list[Column], out: str, inverse: bool = False) -> DataFrame:
    """Adds out: the place of x under a permutation of 0..n-1 (swap-or-not shuffle, Hoang, Morris, Rogaway 2012).

    Each round pairs x with its mirror around a pseudorandom point and swaps the pair or not by a pseudorandom bit of the
    pair, so it is its own inverse; the rounds backwards undo the permutation. No state, no sort, any n.
    """
    df = df.withColumn(out, F.col(x).cast("long"))
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        mirror = F.pmod(F.pmod(F.xxhash64(*keys, F.lit(r)), F.col(n)) - F.col(out), F.col(n))
        df = df.withColumn("_mirror", mirror)
        bit = F.xxhash64(F.greatest(F.col(out), F.col("_mirror")), *keys, F.lit(r + 1000)).bitwiseAND(F.lit(1))
        df = df.withColumn(out, F.when(bit == 1, F.col("_mirror")).otherwise(F.col(out)))
    return df.drop("_mirror")


def targets(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """A row for each source: sid (its place by code point, null last), source, source_size, target.

    Water filling in closed form: sources in the order in which a rising level would fill them; one is full if the level
    reached with all before it full is at least its own.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by = by.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    before = Window.orderBy("_level", "sid").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("_level", F.col("_cap") / F.col("_w"))
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    w_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    by = by.withColumn("_reached", left / w_left).withColumn("_full", F.col("_reached") >= F.col("_level"))
    level = F.max(F.when(~F.col("_full"), F.col("_reached"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w"))
    return by.select("sid", "source", "source_size", "n_docs", target.alias("target"))


def _plans(by: DataFrame, block: int, cap: float, seed: int) -> DataFrame:
    """For each source with words: its blocks, the slots that meet its target, and where its short last block falls."""
    n, size = F.col("_n"), F.lit(block)
    by = by.where("source_size > 0").withColumn("_n", F.col("source_size"))
    by = by.withColumn("_t", F.least(F.round("target").cast("long"), F.floor(n * cap).cast("long")))
    by = by.withColumn("_blocks", F.ceil(n / size)).withColumn("_short", n - (F.col("_blocks") - 1) * size)
    by = by.withColumn("_last", F.floor(F.col("_t") / n)).withColumn("_end", F.col("_blocks") - 1)
    by = permuted(by, "_end", "_blocks", [F.col("sid"), F.col("_last"), F.lit(seed)], "_short_at", inverse=True)
    rest, lost = F.col("_t") - F.col("_last") * n, size - F.col("_short")
    plain = F.ceil(rest / size)
    more = F.when(F.col("_short_at") < plain, F.ceil((rest + lost) / size)).otherwise(plain)
    return by.withColumn("_slots", F.col("_last") * F.col("_blocks") + F.least(more, F.col("_blocks"))).drop("_end")


#: What a slot needs to know of its source.
_OWN = ["_n", "_t", "_blocks", "_short", "_last", "_short_at", "_slots"]


def _drawn(plans: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, sid and ordinal of every slot: multinomial draws by shard, repaired to each source's number of slots."""
    spark = plans.sparkSession
    upto = F.sum("_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    cell = lambda x: F.floor(x * float(CELLS) / n_slots).cast("long")
    cells = (
        plans.withColumn("_upto", upto)
        .withColumn("_hi", cell(F.col("_upto")))
        .withColumn("_lo", cell(F.col("_upto") - F.col("_slots")))
        .where("_hi > _lo")
        .select("sid", *_OWN, F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_cell"))
    )
    drawn = spark.range(n_slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(CELLS)).alias("_cell")
    )
    # at most CELLS rows by construction, so a broadcast at any input size
    counts = drawn.join(F.broadcast(cells), "_cell").groupBy("shard", "sid").agg(
        F.count("*").alias("_c"), *[F.first(c).alias(c) for c in _OWN]
    )
    counts = counts.withColumn("_part", F.floor(F.col("shard") / 4096))
    counts = materialise(running_start(counts, ["sid"], "_part", ["shard"], "_c", "_start"))
    kept = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_slots") - F.col("_start")))
    counts = counts.withColumn("_kept", kept).withColumn("_over", F.col("_c") - F.col("_kept")).withColumn("_all", F.lit(0))

    whole = counts.where("_kept > 0").select(
        "shard", "sid", *_OWN, F.explode(F.expr("sequence(_start, _start + _kept - 1)")).alias("ordinal")
    )
    over = running_start(counts.where("_over > 0"), ["_all"], "_part", ["shard", "sid"], "_over", "_unit")
    over = over.select("shard", F.explode(F.expr("sequence(_unit, _unit + _over - 1)")).alias("_unit"))
    have = counts.groupBy("sid").agg(F.sum("_c").alias("_have"))
    short = plans.join(have, "sid", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    short = short.where("_have < _slots").withColumn("_lack", F.col("_slots") - F.col("_have"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("_unit0", F.coalesce(F.sum("_lack").over(before), F.lit(0)))
    short = short.select(
        "sid", *_OWN, "_unit0", F.explode(F.expr("sequence(_have, _slots - 1)")).alias("ordinal"), "_have"
    ).withColumn("_unit", F.col("_unit0") + F.col("ordinal") - F.col("_have"))
    moved = over.join(short, "_unit").select("shard", "sid", *_OWN, "ordinal")
    return whole.unionByName(moved)


def mix(
    docs: DataFrame, block: int = 128, shard_slots: int = 4096, share: float = 1.5, cap: float = 2.0,
    weights: tuple[int, ...] = (3, 1, 2), seed: int = 42, row_id: str | None = None,
) -> Mix:
    """Plan of a mix over docs(doc_id, text, source). block: words; shard_slots: slots of an output shard; share: words
    taken, of all; cap: most times a source is taken. row_id: a column that tells the rows of docs apart, if they have one.
    The same rows give the same mix."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *([F.col(row_id).alias("_rid")] if row_id else []))
    slim = materialise(slim) if row_id else with_row_id(slim)
    by = materialise(targets(slim, share, cap, weights))
    plans = materialise(_plans(by, block, cap, seed))
    total = plans.agg(F.sum("_slots").alias("n"), F.sum("n_docs").alias("d")).first()
    n_slots, n_docs = int(total["n"] or 0), int(total["d"] or 0)

    sized = slim.join(by.select("sid", F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    if n_slots:
        slots = _drawn(plans, n_slots, shard_slots, seed)
    else:
        slots = plans.limit(0).select(F.lit(0).cast("long").alias("shard"), "sid", *_OWN, F.lit(0).cast("long").alias("ordinal"))
    slots = slots.withColumn("pass", F.floor(F.col("ordinal") / F.col("_blocks"))).withColumn("_i", F.col("ordinal") % F.col("_blocks"))
    # written at once: a filter pushed through the rounds would repeat each in the next
    slots = materialise(permuted(slots, "_i", "_blocks", [F.col("sid"), F.col("pass"), F.lit(seed)], "block"))
    whole = F.when(F.col("block") == F.col("_blocks") - 1, F.col("_short")).otherwise(F.lit(block))
    # only the pass that meets the target can be cut, at its last slot
    gone = F.col("_i") * block - F.when(F.col("_short_at") < F.col("_i"), block - F.col("_short")).otherwise(0)
    cut = F.when(F.col("pass") < F.col("_last"), whole).otherwise(F.least(whole, F.col("_t") - F.col("_last") * F.col("_n") - gone))
    slots = slots.select("shard", "sid", "pass", "block", cut.cast("long").alias("take")).where("take > 0")

    # as many chunks as a shuffle has partitions at least, so that a source's documents are dealt out at any size
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_docs / CHUNK_ROWS))
    worded = sized.where("size > 0").withColumn("_order", F.xxhash64("doc_id", F.lit(seed)))
    # chunks are ranges of the order, so their number changes no place
    share_of = F.col("_order").cast("double") / float(1 << 64) + 0.5
    worded = worded.withColumn("_chunk", F.least(F.floor(share_of * chunks), F.lit(chunks - 1)).cast("long"))
    placed = running_start(worded, ["sid"], "_chunk", ["_order", "doc_id", "size", "_rid"], "size", "_at")
    first, last = F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block)
    packed = placed.select("_rid", "sid", "size", "_at", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("_at"), F.col("block") * block)
    end = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * block)
    packed = packed.select("_rid", "sid", "block", (start - F.col("_at")).alias("word_from"), (start - F.col("block") * block).alias("_in"), (end - start).alias("_len"))
    pieces = slots.join(packed, ["sid", "block"]).withColumn("n_words", F.least(F.col("_len"), F.col("take") - F.col("_in")))
    pieces = pieces.where("n_words > 0").select("shard", "sid", "block", "pass", "_rid", "word_from", "n_words")
    return Mix(sized, slots, pieces)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and pass with the text of the words that the pass takes of it, blanks
    between them as they were, and n_chars anew; all other columns as they are, whatever their names. What a pass takes whole
    stays as it is."""
    rid = free_name(docs, "_rid")
    base = with_row_id(docs, rid)
    plan = mix(base.select("doc_id", "source", "text", F.col(rid).alias("_rid")), row_id="_rid", **options)
    spans = plan.pieces.groupBy("_rid", "pass").agg(
        F.array_sort(F.collect_list(F.struct("word_from", "n_words"))).alias("_spans"), F.sum("n_words").alias("_taken")
    ).drop("pass")
    # the row in one column, so that no name of its own meets another
    rows = base.select(F.col(rid).alias("_rid"), F.col("text").alias("_text"), F.struct(*all_of(docs)).alias("_row"))
    # word by word, each with the blanks after it; blanks before the first word belong to it
    parts = F.split("_text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("_text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    words = rows.join(spans.hint("shuffle_hash"), "_rid")
    words = words.withColumn("_whole", F.col("_taken") == n_words(F.col("_text")))
    words = words.withColumn("_parts", F.when(~F.col("_whole"), parts)).withColumn("_lead", lead)
    cut = F.array_join(
        F.transform("_spans", lambda s: F.array_join(F.slice("_parts", (s["word_from"] + 1 + F.col("_lead")).cast("int"), s["n_words"].cast("int")), "")), ""
    )
    words = words.withColumn("_text", F.when(F.col("_whole"), F.col("_text")).otherwise(cut))
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return words.select(*[made.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op1_mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents under the contract's shares."""
    plan = mix(docs)
    taken = plan.pieces.groupBy("_rid").agg(F.sum("n_words").alias("taken"))
    rows = plan.documents.join(taken, "_rid", "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
