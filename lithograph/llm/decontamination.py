"""Benchmark decontamination by SimHash windows (operator 4), in DataFrame functions only.

Documents are compared with benchmark items in windows of the item's size in words. A window and an item are multisets
of K-word shingles, and similar if sum of minima / sum of maxima of the multiplicities reaches a threshold.

1. Windows: only shingles that some item of the window's size has can make it similar to such an item, and moving a
   window right past another shingle never lowers a similarity. So windows begin at such a shingle (or end with the
   document) and hold as many of them as the threshold asks. Which item of that size it may be is left to the fingerprints.
2. Fingerprints: 64-bit SimHash of the multisets. Windows meet items of their size by multi-index Hamming blocks: of 4
   blocks of 16 bits, fingerprints within RADIUS = 19 differ in at most 4 bits in one, and each item is entered under all
   2,517 values that near, in every block. A chance pair agrees in a block once in seven times and lies within the radius
   once in a thousand; a pair just at the threshold differs in 11 bits on average (3 standard deviation).
3. Verification: the exact similarity of the multisets.

Texts are read twice: once hashed to shingles that stay if an item has them, once joined to the few rows that have
windows. That join and the filtering one always shuffle, whatever the size, so each costs one shuffle of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import word_array, written

K = 5
NUM, DEN = 75, 100
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Up to so many different benchmark shingles (16 bytes each) are broadcast; beyond, the join is left to Spark.
BROADCAST_SHINGLES = 1_000_000


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(words: str, k: int) -> Column:
    """Hashes of all k-word windows of an array of word hashes, in order; none with fewer words."""
    gram = ", ".join(f"{words}[cast(i + {j} as int)]" for j in range(k))
    return F.expr(f"case when size({words}) >= {k} then transform(sequence(0, size({words}) - {k}), i -> xxhash64({gram})) else cast(array() as array<bigint>) end")


def row_of(docs: DataFrame) -> Column:
    """A row's identity, never null: doc_id, null included, and a hash of its text. Joins take nulls within it as equal."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))


def hashed_words(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.transform(word_array(lowered(F.col("text"))), lambda w: F.xxhash64(w)).alias("words"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, k (shingle length: K, or all words of shorter items), grams; items without words are left out."""
    worded = hashed_words(benchmark, "item_id").where("size(words) > 0").withColumn("n_words", F.size("words")).withColumn("k", F.least(F.lit(K), F.col("n_words")))
    return worded.select("item_id", "n_words", "k", grams_of_size("words").alias("grams")).withColumn("n_grams", F.size("grams"))


def grams_of_size(words: str) -> Column:
    """Shingles of the length ``k`` (a column) of an array of word hashes."""
    grams = F.when(F.col("k") == K, shingles(words, K))
    for k in range(1, K):
        grams = grams.when(F.col("k") == k, shingles(words, k))
    return grams


def shared_shingles(docs: DataFrame, items: DataFrame) -> DataFrame:
    """From row, text: row, n_words, n_grams, length (of the document), places: ascending places of the shingles that items of n_words words have."""
    entries = written(items.select("n_words", "n_grams", F.col("k").alias("of_k"), F.explode("grams").alias("entry")).distinct(), "entries")
    few = entries.count() <= BROADCAST_SHINGLES
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect()) or [K]  # at most K values
    by_k = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), shingles("words", k).alias("grams")) for k in sizes])).alias("s")
    worded = hashed_words(docs, "row").select("row", F.size("words").alias("length"), by_k)
    placed = worded.select("row", "length", "s.k", F.posexplode("s.grams").alias("place", "gram"))
    met = placed.join(F.broadcast(entries) if few else entries.hint("merge"), (F.col("gram") == F.col("entry")) & (F.col("of_k") == F.col("k")))
    return met.groupBy("row", "length", "n_words", "n_grams").agg(F.sort_array(F.collect_set("place")).alias("places"))


def window_starts(met: DataFrame) -> DataFrame:
    """row, n_words, start: the windows that can be similar to an item of n_words words, which has n_grams shingles."""
    met = met.withColumn("need", F.expr(f"(n_grams * {NUM} + {DEN - 1}) div {DEN}")).where("size(places) >= need")
    starts = F.expr("filter(sequence(0, size(places) - cast(need as int)), i -> places[cast(i + need - 1 as int)] - places[i] < n_grams)")
    met = met.select("row", "n_words", "length", "places", F.explode(starts).alias("i"))
    return met.select("row", "n_words", F.expr("greatest(0, least(places[i], length - n_words))").alias("start")).distinct()


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint: bit b is set if it is in more than half of the shingles ``grams``, repeats counted.

    Two counters of 32 bits are summed in each long, which the words of one text can't overflow.
    """
    exploded = rows.select(*keys, F.explode("grams").alias("gram"))
    both = lambda g: f"(shiftrightunsigned(gram, {2 * g}) & 1L) + shiftleft(shiftrightunsigned(gram, {2 * g + 1}) & 1L, 32)"
    sums = exploded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(both(g))).alias(f"c{g}") for g in range(32)])
    bits = " | ".join(f"shiftleft(cast(2 * (shiftrightunsigned(c{b // 2}, {32 * (b % 2)}) & {(1 << 32) - 1}L) > n as bigint), {b})" for b in range(64))
    return sums.select(*keys, F.expr(bits).alias("fingerprint"))


#: All block values with BLOCK_RADIUS bits at most, made once a query, so that plans stay small.
MASKS = f"(select collect_list(cast(id as int)) from range({1 << BLOCK_BITS}) where bit_count(id) <= {BLOCK_RADIUS})"


def blocks(fingerprint: str) -> Column:
    return F.array(*[F.expr(f"cast(shiftrightunsigned({fingerprint}, {BLOCK_BITS * b}) & {(1 << BLOCK_BITS) - 1}L as int)") for b in range(BLOCKS)])


def numbered(grams: str) -> Column:
    """Shingles made different by how often they came before, so that set operations count multiplicities."""
    return F.expr(f"case when size(array_distinct({grams})) = size({grams}) then transform({grams}, x -> xxhash64(x, 0)) else transform({grams}, (x, i) -> xxhash64(x, size(filter(slice({grams}, 1, i), y -> y = x)))) end")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``contaminated`` tells, by row (``row_of``)."""
    docs = docs.select(row_of(docs).alias("row"), "text")
    items = written(items_of(benchmark), "items")
    windows = written(window_starts(shared_shingles(docs, items)), "windows")
    wanted = windows.groupBy(F.col("row").alias("at")).agg(F.collect_set(F.struct("n_words", "start")).alias("windows"))
    texts = docs.join(wanted.hint("merge"), F.col("row") == F.col("at")).select("row", "text", "windows").dropDuplicates(["row"])  # repeats would count twice in a fingerprint
    worded = texts.select("row", "windows", F.transform(word_array(lowered(F.col("text"))), lambda w: F.xxhash64(w)).alias("all"))
    cut = worded.select("row", "all", F.explode("windows").alias("w")).select("row", "w.*", F.expr("slice(all, w.start + 1, w.n_words)").alias("words"))
    cut = cut.withColumn("k", F.least(F.lit(K), F.col("n_words"))).select("row", "n_words", "start", grams_of_size("words").alias("grams"))
    cut = written(cut.where("size(grams) > 0"), "cut")
    prints = simhash(cut, ["row", "n_words", "start"])
    marks = simhash(items, ["item_id", "n_words"])
    probes = prints.select("*", F.posexplode(blocks("fingerprint")).alias("block", "value"))
    index = marks.withColumnsRenamed({"fingerprint": "mark", "n_words": "item_words"}).select("*", F.posexplode(blocks("mark")).alias("item_block", "near_to"))
    index = index.select("item_id", "item_words", "mark", "item_block", "near_to", F.expr(MASKS).alias("masks"))
    index = index.select("item_id", "item_words", "mark", "item_block", "near_to", F.explode("masks").alias("mask")).withColumn("near", F.col("near_to").bitwiseXOR(F.col("mask")))
    pairs = probes.join(index.hint("merge"), (F.col("n_words") == F.col("item_words")) & (F.col("block") == F.col("item_block")) & (F.col("value") == F.col("near")))
    pairs = pairs.select("row", "start", "n_words", "item_id", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("mark"))).alias("distance")).where(F.col("distance") <= RADIUS).distinct()
    keyed = pairs.hint("merge").join(cut, ["row", "n_words", "start"]).join(items.select("item_id", F.col("grams").alias("item_grams")), "item_id")
    common = F.size(F.array_intersect(numbered("grams"), numbered("item_grams"))).alias("common")
    sized = keyed.select("row", "item_id", "start", "distance", common, (F.size("grams") + F.size("item_grams")).alias("total"))
    alike = sized.where(DEN * F.col("common") >= NUM * (F.col("total") - F.col("common")))
    similarity = F.col("common") / (F.col("total") - F.col("common"))
    best = alike.groupBy("row", "item_id").agg(F.max(F.struct(similarity.alias("similarity"), (-F.col("start")).alias("before"), F.col("distance"))).alias("b"))
    return best.select("row", "item_id", "b.similarity", (-F.col("b.before")).alias("start_word"), "b.distance")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, distance for each document and item that are similar in some window.

    The window of highest similarity is told (the first of these). Words are lower-cased (A-Z); K-word shingles; items of
    fewer words are one shingle. A document shorter than an item is one window. Null and blank texts match nothing; rows
    that repeat a doc_id and its text count once; rows with a null doc_id, or one doc_id and different texts, are
    documents of their own; other columns are ignored; an empty table gives no rows.
    """
    return contaminated_rows(docs, benchmark).select("row.doc_id", "item_id", "similarity", "start_word", "distance")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are similar to no benchmark item in any window, with all their columns."""
    leaks = written(contaminated_rows(docs, benchmark).select(F.col("row").alias("_row")).distinct(), "leaks")
    return docs.join(leaks.hint("merge"), row_of(docs) == leaks["_row"], "left_anti").select(docs.columns)
