"""Groups of spelling variants in a corpus's vocabulary (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one of the other. Near words are found by
two-dimensional range reporting. Words of one length, sorted as they are, have those with a given prefix in one interval;
sorted by their reversed spelling, those with a given suffix. A word is a point (place in forward order, place in reverse
order), and the words that differ from ``w`` at place i alone are the points in the rectangle of the interval of w[:i] and
the interval of w[i+1:]. A wavelet tree over the points reports them in time by what there is to report. Deletions are the
same rectangles among the words that are one shorter; insertions are deletions seen from the other word.

No task gets the vocabulary. Two words that differ at a place i of [a, b) agree in their first a and in what stands behind
place b, so words are dealt by *range keys*: kind (replaced, deleted), length, a, b, and the two shared ends. Each word
starts with the two halves of its places. A key that too many words have is cut in two, at most until its range is a
single place, where words that share the key differ in one code point: their number is bounded by the alphabet. Keys are
gathered by a hash into blocks of one kind, length and range, and each block is searched by one tree for the places of its
range, so every pair is found once. A block tells each of its words how many near words it has there, and the best of
them, so no list of pairs is ever shuffled.

All code points are below 256 (the words' alphabet is Latin-1), so a word is as many bytes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: What words are made of; the shortest and the rarest words that count; what a form must be more frequent by.
LETTERS, LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = "A-Za-z\\u00C0-\\u00FF", 7, 2, 10
#: One run in so many loses a code point.
DELETED_IN = 31
#: Words of a range key up to which it isn't cut; words of a block, and their bytes, about.
KEY_WORDS, BLOCK_WORDS, BLOCK_BYTES = 20_000, 50_000, 1 << 23
#: Rows (kind, length, range) up to which the numbers of blocks are broadcast.
FEW_BLOCK_ROWS = 100_000
REPLACED, DELETED = 0, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: distinct words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more.

    Only A-Z are lower-cased. Where DELETED_IN divides the CRC-32 of ``<doc_id>:<word>`` (a null doc_id is empty), the
    word's code point at that number modulo its length is left out. Runs that are too short can't become longer, so they
    aren't even extracted.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    words = rows.select(F.when(F.col("h") % DELETED_IN == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


# -- the wavelet tree ---------------------------------------------------------------------------------------------------


class WaveletTree:
    """Range reporting over the points (x, y[x]), x below n, of a permutation y.

    A node holds the values of one range of y in the order of x; ``ones`` counts, per level, the values before each place
    that go to the right child. All nodes of a level lie side by side (zeros first), which is the matrix layout.
    """

    def __init__(self, y: np.ndarray):
        self.n, self.bits = len(y), max(1, int(len(y) - 1).bit_length()) if len(y) else 1
        self.ones, self.zeros, values = [], [], y.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, y): the points of each rectangle [x1, x2) x [y1, y2). All queries go down the tree together."""
        query = np.flatnonzero((x1 < x2) & (y1 < y2))
        left, right, low, high = x1[query].astype(np.int64), x2[query].astype(np.int64), y1.astype(np.int64), y2.astype(np.int64)
        first = np.zeros(len(query), np.int64)  # the least y of the node
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one_left, one_right = ones[left].astype(np.int64), ones[right].astype(np.int64)
            middle = first + (1 << level)
            down = (right - one_right > left - one_left) & (low[query] < middle)
            up = (one_right > one_left) & (high[query] > middle)
            left, right = np.concatenate([(left - one_left)[down], zeros + one_left[up]]), np.concatenate([(right - one_right)[down], zeros + one_right[up]])
            query, first = np.concatenate([query[down], query[up]]), np.concatenate([first[down], middle[up]])
            inside = (first < high[query]) & (first + (1 << level) > low[query])
            left, right, query, first = left[inside], right[inside], query[inside], first[inside]
        return query, first


class Ordered:
    """Words of one length in forward order, in reverse order, and a wavelet tree over the two."""

    def __init__(self, words: np.ndarray):
        """``words``: distinct, as rows of bytes."""
        self.length = words.shape[1]
        self.forward = self._sorted(words)
        self.words = words[self.forward]
        self.reverse = self._sorted(self.words[:, ::-1])  # forward places by reverse place
        self.heads, self.tails = self._texts(self.words), self._texts(self.words[self.reverse][:, ::-1])
        y = np.empty(len(words), np.int64)
        y[self.reverse] = np.arange(len(words))
        self.tree = WaveletTree(y)

    @staticmethod
    def _texts(words: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words).view(f"S{words.shape[1]}").reshape(-1)

    def _sorted(self, words: np.ndarray) -> np.ndarray:
        return np.argsort(self._texts(words), kind="stable")

    @staticmethod
    def _interval(ordered: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where, in ``ordered`` texts, those begin that start with each of ``starts`` (rows of bytes), and where they end."""
        n, width = starts.shape
        if not width:
            return np.zeros(n, np.int64), np.full(n, len(ordered))
        least, most = np.zeros((n, length), np.uint8), np.full((n, length), 255, np.uint8)
        least[:, :width] = most[:, :width] = starts
        return np.searchsorted(ordered, Ordered._texts(least), "left"), np.searchsorted(ordered, Ordered._texts(most), "right")

    def _shared(self, ordered: np.ndarray, texts: np.ndarray, asked: np.ndarray, skip: int) -> np.ndarray:
        """How much each asked row has in common with its neighbours in ``ordered`` (rows of bytes; ``texts``: the same),
        which is the most that it has with any. ``skip``: 1 if asked rows are among them, and don't count."""
        place, most = np.searchsorted(texts, self._texts(asked)), np.zeros(len(asked), np.int64)
        for at in (place - 1, place + skip):
            inside = (at >= 0) & (at < len(ordered))
            different = ordered[at[inside]] != asked[inside]
            most[inside] = np.maximum(most[inside], np.where(different.any(axis=1), different.argmax(axis=1), asked.shape[1]))
        return most

    def places(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last place at which an edit of each asked row may make a word: others leave a prefix or a
        suffix that no (other) word has."""
        n, skip = self.length, int(asked.shape[1] == self.length)
        prefix = self._shared(self.words, self.heads, asked[:, :n], skip)
        suffix = self._shared(self.words[self.reverse][:, ::-1], self.tails, asked[:, ::-1][:, :n], skip)
        return asked.shape[1] - 1 - suffix, prefix

    def prefix(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._interval(self.heads, starts, self.length)

    def suffix(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._interval(self.tails, ends[:, ::-1], self.length)


def near_pairs(asked: np.ndarray, among: Ordered, places: range) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``among.words``) of all words that one edit at one of ``places`` makes of an asked one.

    If ``among`` has words of the same length, the edit replaces (and a word isn't near to itself); else it deletes. Of
    equal code points in a row only the first is deleted, for all give the same word.
    """
    asks, found = [], []
    same = among.length == asked.shape[1]
    first, last = among.places(asked)
    first, last = np.maximum(first, places.start), np.minimum(last, places.stop - 1)
    step = np.zeros(asked.shape[1] + 1, np.int64)
    np.add.at(step, first[first <= last], 1)
    np.add.at(step, last[first <= last] + 1, -1)
    for i in np.flatnonzero(np.cumsum(step)).tolist():
        may = (first <= i) & (i <= last)
        rows = np.flatnonzero(may if same or i == 0 else may & (asked[:, i] != asked[:, i - 1]))
        x1, x2 = among.prefix(asked[rows, :i])
        rows, x1, x2 = rows[x2 - x1 > same], x1[x2 - x1 > same], x2[x2 - x1 > same]  # the word itself is in both intervals
        y1, y2 = among.suffix(asked[rows, i + 1 :])
        some = y2 - y1 > same
        query, y = among.tree.report(x1[some], x2[some], y1[some], y2[some])
        asks.append(rows[some][query])
        found.append(among.reverse[y])
    ask, other = np.concatenate(asks or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])
    if same:
        different = (asked[ask] != among.words[other]).any(axis=1)
        ask, other = ask[different], other[different]
    return ask, other


def best_near(n_words: int, of: np.ndarray, near_n: np.ndarray, near_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: number of its pairs, and the pair of largest n (ties: smallest rank), -1 without any."""
    count, best = np.bincount(of, minlength=n_words), np.full(n_words, -1)
    order = np.lexsort((near_rank, -near_n, of))
    first = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])] if len(of) else order
    best[of[first]] = first
    return count, best


# -- dealing ------------------------------------------------------------------------------------------------------------

KEY = ["kind", "length", "a", "b", "start", "end"]


def shared_ends(word: Column, length: Column, kind: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a word shares with those that differ from it in the places [a, b) of the longer one, of ``length``."""
    behind = length - b  # as many code points, in both words
    return F.substr(word, F.lit(1), a), F.substr(word, F.length(word) - behind + 1)


def range_keys(words: DataFrame) -> DataFrame:
    """word, n, is_long and a range key for both halves of all that a word may be: one that replaces, and the longer and
    the shorter one of a deletion."""
    size = F.length("word")
    roles = F.array(
        F.struct(F.lit(REPLACED).alias("kind"), size.alias("length"), F.lit(True).alias("is_long")),
        F.struct(F.lit(DELETED).alias("kind"), size.alias("length"), F.lit(True).alias("is_long")),
        F.struct(F.lit(DELETED).alias("kind"), (size + 1).alias("length"), F.lit(False).alias("is_long")),
    )
    rows = words.select("word", "n", F.inline(roles)).where(~((F.col("kind") == DELETED) & (F.col("length") == LEAST_LENGTH)))
    return _cut(rows.select("word", "n", "kind", "length", "is_long", F.lit(0).alias("a"), F.col("length").alias("b")))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row for both halves of its range, with the ends that are shared there."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = rows.select("word", "n", "kind", "length", "is_long", F.inline(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))))
    start, end = shared_ends(F.col("word"), F.col("length"), F.col("kind"), F.col("a"), F.col("b"))
    return halves.select("word", "n", "kind", "length", "is_long", "a", "b", start.alias("start"), end.alias("end"))


def dealt_keys(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """``range_keys`` of which none is shared by more than ``key_words`` words, but for ranges of a single place."""
    rows, done = range_keys(words), []
    while True:
        rows = written(rows, "keys")
        counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("holders")).where((F.col("holders") > key_words) & (F.col("b") - F.col("a") > 1)).drop("holders")
        counts = written(counts, "large")  # a key of that many words each: few
        if counts.isEmpty():
            discard(counts)
            return _all([*done, rows])
        done.append(rows.join(counts, KEY, "left_anti"))
        rows = _cut(rows.join(counts, KEY, "left_semi"))


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def near_words(words: DataFrame, key_words: int = KEY_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, form, form_n (the near word of largest n, ties the smallest) of those of ``words`` (word, n) that have
    near words."""
    keyed = dealt_keys(words, key_words)
    sized = F.greatest(F.count(F.lit(1)) / block_words, F.sum(F.octet_length("word")) / BLOCK_BYTES)
    blocks = keyed.groupBy("kind", "length", "a", "b").agg(F.ceil(sized).alias("blocks"))
    blocks = written(blocks, "blocks")  # a row per kind, length and range: as many as lengths of words
    few = blocks.count() <= FEW_BLOCK_ROWS
    # broadcast or dealt anew, or else Spark would leave all blocks of a length and range where the join gathered them
    placed = keyed.join(F.broadcast(blocks) if few else blocks.hint("merge"), ["kind", "length", "a", "b"]).withColumn("block", F.pmod(F.xxhash64("start", "end"), "blocks"))
    if not few:
        placed = placed.repartition("kind", "length", "a", "b", "block")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        kind, length, a, b = (k.as_py() for k in key[:4])
        texts, n, long = table.column("word").to_pylist(), np.array(table.column("n")), np.array(table.column("is_long"))
        counts, bests = np.zeros(len(texts), np.int64), np.full(len(texts), -1)
        spelled = [t.encode("latin-1") for t in texts]
        rank = np.empty(len(texts), np.int64)
        rank[sorted(range(len(texts)), key=spelled.__getitem__)] = np.arange(len(texts))
        asking, held = np.flatnonzero(long), np.flatnonzero(long if kind == REPLACED else ~long)
        if len(asking) and len(held):
            matrix = lambda rows: np.frombuffer(b"".join([spelled[i] for i in rows]), np.uint8).reshape(len(rows), -1)
            among = Ordered(matrix(held))
            ask, other = near_pairs(matrix(asking), among, range(a, b))
            ask, other = asking[ask], held[among.forward[other]]
            if kind == DELETED:  # seen from both sides; replacing is found from both sides as it is
                ask, other = np.concatenate([ask, other]), np.concatenate([other, ask])
            counts, best = best_near(len(texts), ask, n[other], rank[other])
            bests[best >= 0] = other[best[best >= 0]]
        some = np.flatnonzero(counts)
        return pa.table({"word": pa.array([texts[i] for i in some], pa.string()), "found": pa.array(counts[some], pa.int64()), "best": pa.array([texts[i] for i in bests[some]], pa.string()), "best_n": pa.array(n[bests[some]], pa.int64())})

    told = placed.groupBy("kind", "length", "a", "b", "block").applyInArrow(search, "word string, found long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return told.groupBy("word").agg(F.sum("found").alias("n_near"), best).select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """word, root of ``forms`` (word, form): where following forms ends. A form is FORM_FACTOR times as frequent as its word,
    so chains are short; each round doubles what is followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        before, now = now, written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(before)
    raise RuntimeError(f"forms not followed to their ends after {rounds} rounds")


def variants(docs: DataFrame, key_words: int = KEY_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n, as the module says.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is FORM_FACTOR times the
    word's n or more, else null; root is where forms lead in the end, the word itself if it has none. Null texts have no
    words; repeated rows count again; an empty table gives no rows; other columns are ignored.
    """
    words = written(vocabulary(docs), "vocabulary")
    near = words.select("word", "n").join(near_words(words, key_words, block_words), "word", "left")
    form = lambda c: F.when(F.col("form_n") >= FORM_FACTOR * F.col("n"), F.col(c))
    told = written(near.select("word", form("form").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form("form_n").alias("form_n")), "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
