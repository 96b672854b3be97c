"""Mix sources to target weights (operator 3), in DataFrame functions only.

The words of each source are packed end to end into blocks of a fixed length. The mix is a row of output slots, one
block each, cut into output shards. Each source has as many slots as its target asks; a keyed permutation of all slots
deals them to the shards, so a shard's source counts are a multinomial draw under the condition that the draws of all
shards add up to the targets (without it, totals would stray from their targets by the root of the number of slots).
Slots of a source are mapped through a pseudorandom permutation of the source's block indexes, another one for each pass
over the source; blocks are then joined by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: Documents of a source that one task lays in order, about.
BUCKET_DOCS = 50_000
#: Slots that are numbered at once: so many pieces of the second size make up one of the first.
STEPS = (1 << 26, 1 << 13)
ROUNDS = 16


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources are ordered by code point, null last, and weigh ``weights``, repeating. Targets share the total size by
    weight; none exceeds ``cap`` times its source, and what is cut off is shared again. With sources in ascending order
    of cap / weight, the k first are at their cap for the smallest k that leaves no other above its own.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") * cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))).alias("_left"),
        F.sum("weight").over(rest).alias("_weights"),
    )
    capped = (F.col("_left") / F.col("_weights") * F.col("weight")) > F.col("source_size") * cap
    # the share per weight of those not capped is the one at the first source that isn't
    share = F.min(F.when(~capped, F.struct(F.col("source_size") * cap / F.col("weight"), F.col("_left") / F.col("_weights")))).over(Window.partitionBy())
    return level.select(
        "source", "source_size", "weight",
        F.least((F.col("source_size") * cap).cast("double"), F.coalesce(share["col2"] * F.col("weight"), F.lit(0.0))).alias("target"),
    )


def permuted(index: Column, size: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of 0 .. size - 1 applied to ``index``: swap-or-not rounds, exact for any size."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), size) - x, size)
        chosen = lambda p: F.when(F.xxhash64(r, F.greatest(x, p), *key).bitwiseAND(F.lit(1)) == 1, p).otherwise(x)
        return F.element_at(F.transform(F.array(partner), chosen), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def pack(sized: DataFrame, block_words: int = BLOCK_WORDS, buckets: int = 1024) -> DataFrame:
    """Lay the words of each source end to end and cut them into blocks: source, block, row, doc_id, from_word, n_words.

    Documents are laid in the order of a hash bucket, then doc_id, so that running sums stay inside a bucket; only the
    totals of the buckets (``buckets`` rows per source) are summed over a whole source.
    """
    dealt = sized.where("size > 0").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "size"), F.lit(buckets)))
    totals = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_total"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_source"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("doc_id", "text_hash", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.hint("merge").join(offsets, local["source"].eqNullSafe(offsets["_source"]) & (F.col("_bucket") == F.col("_at"))).select(
        "source", "row", "doc_id", "size", (F.col("_local") + F.col("_offset")).alias("_start")
    )
    blocks = placed.select("*", F.explode(F.expr(f"sequence(_start div {block_words}, (_start + size - 1) div {block_words})")).alias("block"))
    first, last = F.greatest(F.col("_start"), F.col("block") * block_words), F.least(F.col("_start") + F.col("size"), (F.col("block") + 1) * block_words)
    return blocks.select("source", "block", "row", "doc_id", (first - F.col("_start")).alias("from_word"), (last - first).alias("n_words"))


def draw_slots(targets: DataFrame, seed: int, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, cap: int = MAX_REPEATS) -> DataFrame:
    """The mix as slots: source, shard, slot (place in the shard), k (number within its source), pass, block.

    A source's slots stop at ``cap`` passes over it, so no block is taken more often than that.
    """
    live = targets.where("source_size > 0 and target > 0").withColumn("_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    slots = F.least(F.round(F.col("_blocks") * F.col("target") / F.col("source_size")).cast("long"), cap * F.col("_blocks"))
    live = live.withColumn("_slots", F.greatest(F.lit(1).cast("long"), slots))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    live = live.select(
        "source", "_blocks", "_slots",
        F.row_number().over(order).alias("_no"),
        (F.sum("_slots").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_slots")).alias("_first"),
        F.sum("_slots").over(Window.partitionBy()).alias("_all"),
    )
    # numbers of slots are made in two steps, each dealt over tasks, so that no array and no task has all of a source
    n, end = partitions(targets.sparkSession), F.col("_slots") - 1
    for step in STEPS:
        start = F.lit(0).cast("long") if step == STEPS[0] else F.col("_k")
        until = end if step == STEPS[0] else F.least(end, F.col("_k") + STEPS[0] - 1)
        live = live.withColumn("_k", F.explode(F.sequence(start, until, F.lit(step).cast("long")))).repartition(n, "_no", "_k")
    each = live.select("*", F.explode(F.sequence("_k", F.least(end, F.col("_k") + STEPS[1] - 1))).alias("k"))
    each = each.withColumn("pass", F.expr("k div _blocks")).withColumn("_place", permuted(F.col("_first") + F.col("k"), F.col("_all"), F.lit(seed)))
    block = permuted(F.col("k") % F.col("_blocks"), F.col("_blocks"), F.lit(seed), F.col("_no"), F.col("pass"))
    return each.select("source", F.expr(f"_place div {shard_slots}").alias("shard"), (F.col("_place") % shard_slots).alias("slot"), "k", "pass", block.alias("block"))


def sizes(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, source, text_hash, size (words)."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents, source targets, mix). The mix has a row for each piece of a document in each output slot:
    shard, slot, pass, source, block, row, doc_id, from_word, n_words.

    Null and blank texts have size 0 and are never taken; a null source is a source of its own, the last in order; rows
    that share a doc_id (null included) are separate documents; an empty table gives empty results; other columns are
    ignored. Rows are numbered when their sizes are written, and read from there, so numbers stay as they are.
    """
    sized = written(sizes(docs), "sized")
    targets = written(source_targets(sized), "targets")
    buckets = max(1024, sized.count() // BUCKET_DOCS)
    pieces, slots = pack(sized, block_words, buckets), draw_slots(targets, seed, block_words)
    theirs = slots.withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
    mixed = pieces.join(theirs.hint("merge"), pieces["source"].eqNullSafe(theirs["_source"]) & (pieces["block"] == theirs["_block"]))
    return sized, targets, mixed.select("shard", "slot", "pass", "source", "block", "row", "doc_id", "from_word", "n_words")


def taken(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats counted).

    Each row shows what is taken of it alone, also if it shares its doc_id with others.
    """
    sized, targets, mixed = mix(docs, seed)
    sums = mixed.groupBy("row").agg(F.sum("n_words").alias("taken")).withColumnRenamed("row", "_row")
    per_source = targets.select(F.col("source").alias("_source"), "source_size", "target")
    out = sized.join(per_source, sized["source"].eqNullSafe(per_source["_source"]), "left")
    out = out.join(sums.hint("merge"), out["row"] == sums["_row"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` in the proportions of the mix, with all their columns: each row as often as the mix takes its words.

    A document of which the mix takes a fraction of its words stays, beyond its whole copies, with that fraction as
    probability (by a hash of its doc_id, source and text). Rows with equal doc_id, source and text (nulls included)
    share evenly what is taken of them, so none has more than MAX_REPEATS copies. Documents without words are never taken.
    """
    sized, _, mixed = mix(docs, seed)
    sums = mixed.groupBy("row").agg(F.sum("n_words").alias("_taken")).withColumnRenamed("row", "_row")
    key = ["doc_id", "source", "text_hash"]
    share = sized.where("size > 0").join(sums.hint("merge"), sized["row"] == sums["_row"]).groupBy(*key).agg((F.sum("_taken") / F.sum("size")).alias("share"))
    share = written(share.select(F.struct(*key).alias("of"), "share"), "shares")
    # columns travel in a struct, so none of their names can clash
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("whole"), F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("key"))
    met = whole.join(share.hint("merge"), F.col("key") == F.col("of"))
    unit = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("share") + (unit < F.col("share") - F.floor("share")).cast("long")).cast("int")
    return met.select("whole", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("whole.*")
