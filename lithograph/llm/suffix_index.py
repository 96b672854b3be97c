"""Exact removal of repeated 50-byte strings with a logarithmic index family (operator 10).

The index is a family of levels, each a suffix array: sampled suffixes in the order of their first bytes. A suffix is
sampled where its first ANCHOR bytes hash lowest in some LENGTH-byte window (a minimizer), so every string of LENGTH bytes
holds one sampled suffix, and two documents that share the string sampled the same one. An entry has the suffix's first
KEY bytes, by which arrays are sorted, and 48 bits of a hash of its first ANCHOR bytes, which orders and parts what agrees
that far. Arrays are dealt by that hash into buckets, as many as the bytes of the input ask for.

Documents arrive in batches. A batch gets its own array, which is merge-scanned against every level and in itself:
neighbours that agree in ANCHOR bytes are long-match candidates. The array then becomes a level; two levels of equal size
merge into one of twice the size when the next batch comes, so n batches leave at most log2(n) + 2 levels and each entry is
rewritten log2(n) times at most. An index that is kept (``Index``) takes further batches.

Candidates are verified exactly: the text around each shared anchor (the windows that have it) is dealt out by anchor, all
its LENGTH-byte windows are grouped by hash and compared byte by byte with the one of the smallest doc_id, and the windows
that start in a smaller doc_id too are sent back to their documents, whose bytes they remove. Of equal whole texts only the
first is verified: all windows of the others start in it.

No task gets all holders of a frequent passage. An anchor that many documents of one pack hold is told to them at once,
and one entry of it enters the index. Before stretches are dealt out, equal ones of a pack are left to the smallest
doc_id. Stretches around common anchors, which can all differ where the passage ends, are not dealt out by anchor: their
windows are judged within the pack, and each window's smallest doc_id of the pack is dealt out by the window's hash (these
alone are compared by 128 bits of hashes instead of bytes), so that a window comes once from each pack. Which anchors are
common is kept in a bitmap; one that shares its bit is treated alike in all packs, so it only takes the other way to the
same result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import PACKED, cut, runs
from .shared import discard, has_files, new_folder, passing, salted_join, write, written
from .text_stats import mixed

LENGTH, ANCHOR, KEY = 50, 16, 8
#: Batches that a table is taken into the index in.
BATCHES = 8
#: Bytes of text whose entries, or whose stretches, make up a bucket, about; and least buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 21, 16
#: Rows that a task gathers before it deals them by document, and rows of a blob that isn't dealt.
ROWS_DEALT, ROWS_A_BLOB = 1_000_000, 50_000
#: Entries of all batches that a task holds before it packs them, and documents whose texts are taken from a batch of rows.
ENTRIES_AT_ONCE, TEXTS_AT_ONCE = 800_000, 128
#: Bytes of texts that are hashed in one array, and of stretches whose windows are compared at once.
BYTES_AT_ONCE, COMPARED_AT_ONCE = 1 << 17, 1 << 20
#: An anchor is common if more entries of a batch have it, or more than an eighth as many documents of one pack.
COMMON = 1000
MULTIPLIER, SECOND_MULTIPLIER = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bits of the bitmap of common anchors.
FILTER_BITS = 1 << 24
#: An entry of a batch: the suffix's first KEY bytes as a number, 48 bits of its anchor's hash, its document in the blob's table.
ANCHORED = np.dtype([("key", "<u8"), ("low", "<u4"), ("high", "<u2"), ("of", "<u2")])
#: A level's entry: the same, with the place of its first document in the bucket's table.
PLACED = np.dtype([("key", "<u8"), ("low", "<u4"), ("high", "<u2"), ("of", "<u4")])
HELD = np.dtype([("doc", "<i8"), ("value", "<u8")])
#: A window around a common anchor: its document and two hashes.
LEAST = np.dtype([("doc", "<i8"), ("value", "<u8"), ("second", "<u8")])
#: A stretch of text around an anchor, before its bytes: 32 bits of the anchor, and where it begins in its document, or NOWHERE
#: if it does so at several places or rows share the doc_id.
STRETCH = np.dtype([("doc", "<i8"), ("size", "<u4"), ("anchor", "<u4"), ("start", "<u4")])
NOWHERE = (1 << 32) - 1
#: What is to be removed from a document: a window, wherever it occurs (its hash), or a range of windows (start << 32 | number).
REMOVED = np.dtype([("doc", "<i8"), ("value", "<u8"), ("range", "u1")])
LOW_48 = np.uint64((1 << 48) - 1)


def byte_hashes(data: np.ndarray, k: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Hashes of all k-byte windows, by joining windows of powers of two."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    power, size, out, done = table[data], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = power, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(pow(multiplier, size, 1 << 64)) + power[done : done + n]
                done += size
        if done == k:
            return mixed(out)
        n = len(power) - size
        power = power[:n] * np.uint64(pow(multiplier, size, 1 << 64)) + power[size : size + n]
        size *= 2


def window_anchors(data: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte window the smallest hash of an ANCHOR-byte string in it."""
    least, width, size = byte_hashes(data, ANCHOR), LENGTH - ANCHOR + 1, 1
    n = len(least) - width + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[width - size : width - size + n])


def sampled_places(hashes: np.ndarray, crossing: np.ndarray | None = None) -> np.ndarray:
    """Where the sampled suffixes of texts begin, by the hashes of their ANCHOR-byte strings. ``crossing``: the windows that
    reach over the end of a text."""

    def over(values: np.ndarray, take: np.ufunc) -> np.ndarray:
        """``take`` of each ``width`` neighbours."""
        size, n = 1, len(values) - width + 1
        while size * 2 <= width:
            values = take(values[:-size], values[size:])
            size *= 2
        return take(values[:n], values[width - size : width - size + n])

    width = LENGTH - ANCHOR + 1
    least = over(hashes, np.minimum)
    if crossing is not None:
        least[crossing] = 0
    # a place is lowest in some window if its hash is the greatest of the minima of the windows that have it
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(over(np.concatenate([edge, least, edge]), np.maximum) == hashes)


def crossing_windows(ends: np.ndarray) -> np.ndarray:
    """The LENGTH-byte windows that begin in one text and end in another, by the texts' ends in the joined bytes."""
    return (ends[:-1, None] + np.arange(1 - LENGTH, 0)).reshape(-1)


def entries_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys: the first KEY bytes as big-endian numbers, anchor hashes, numbers of the texts) of the sampled suffixes of texts
    of these ``sizes`` (LENGTH bytes at least), which ``data`` has one after another."""
    hashes, ends = byte_hashes(data, ANCHOR), np.cumsum(sizes)
    place = sampled_places(hashes, crossing_windows(ends))
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, KEY)[place])
    return first.view(">u8").astype(np.uint64).reshape(-1), hashes[place], np.searchsorted(ends, place, "right").astype(np.int32)


def suffix_entries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, anchor hashes) of a text's sampled suffixes."""
    return entries_of(data, np.array([len(data)]))[:2]


def suffix_order(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``np.lexsort((values, keys))`` of rows that are made of runs in that order: their keys are merged, then ties are put right."""
    order = np.argsort(keys, kind="stable")
    ordered, tied = keys[order], values[order]
    odd = (ordered[1:] == ordered[:-1]) & (tied[1:] < tied[:-1])
    if odd.any():
        starts, lengths = runs_of(ordered)
        of = np.repeat(np.arange(len(starts)), lengths)
        wrong = np.zeros(len(starts), bool)
        wrong[of[1:][odd]] = True
        at = np.flatnonzero(wrong[of])
        order[at] = order[at[np.lexsort((tied[at], ordered[at]))]]
    return order


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of rows whose neighbours are equal in all columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def distinct(rows: np.ndarray) -> np.ndarray:
    """The different ones of rows of several columns, in order: np.unique, which compares such rows one by one, takes seven times as long."""
    rows = rows[np.lexsort([rows[n] for n in reversed(rows.dtype.names)])]
    return rows[runs_of(*[rows[n] for n in rows.dtype.names])[0]]


def spread(doc: int, buckets: int) -> int:
    """A bucket for what may lie in any: packs begin with different documents, so they take different ones."""
    return int(mixed(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(buckets))


def buckets_for(n_bytes: int) -> int:
    """Buckets for so many bytes of text: their number hangs on the data alone."""
    return max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES)


def document_buckets(buckets: int) -> int:
    """What is told by document goes to fewer buckets, so that each gets larger pieces of each."""
    return max(LEAST_BUCKETS, buckets // 16)


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, sha256 of the text, first (smallest doc_id of its copies if it has LENGTH bytes or more)."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = written(docs.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha256")), "texts")
    first = texts.where(f"n_bytes >= {LENGTH}").groupBy("sha256").agg(F.min("doc_id").alias("first"))
    return written(salted_join(texts, first, "sha256", "doc_id", "left"), "texts")


def sampled_suffixes(docs: DataFrame, buckets: int, bounds: list[int], common: int = COMMON) -> DataFrame:
    """Suffix entries of the documents (doc_id, text), packed by batch and bucket; rows: batch, level, bucket, entries.

    A document's batch is the number of ``bounds`` (ascending doc_ids) below its doc_id. Level -1: a table of doc_ids, then
    ANCHORED entries in suffix order. Anchors that more than common / 8 documents of a pack hold have one entry there, of
    the smallest doc_id. Level -2: HELD of all documents that hold those. Level -3: those anchors.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list, list, list]] = defaultdict(lambda: ([], [], [], []))
        size, bytes_taken, some, limits = 0, 0, [], np.array(bounds, np.int64)

        def take() -> int:
            """Entries of the texts in ``some`` go to their batches."""
            ids = np.array([d for d, _ in some], np.int64)
            keys, values, of = entries_of(np.frombuffer(b"".join([t for _, t in some]), np.uint8), np.array([len(t) for _, t in some]))
            some.clear()
            numbers = np.searchsorted(limits, ids)
            for number in np.unique(numbers).tolist():
                mine = numbers == number
                chosen, column = mine[of], waiting[number]
                column[0].append(keys[chosen]), column[1].append(values[chosen])
                column[2].append((np.cumsum(mine) - 1 + len(column[3]))[of[chosen]])
                column[3].extend(ids[mine].tolist())
            return len(keys)

        def dealt(batch: int) -> pa.RecordBatch:
            *columns, ids = waiting.pop(batch)
            keys, values, of = (np.concatenate(c) for c in columns)
            del columns
            known = np.array(ids, "<i8")
            order = np.lexsort((known[of], values, keys))  # the pack's suffix array
            order = order[runs_of(known[of[order]], values[order], keys[order])[0]]
            starts, lengths = runs_of(values[order], keys[order])
            many = lengths > common // 8
            told = order[np.repeat(many, lengths)]
            held = np.zeros(len(told), HELD)
            held["value"], held["doc"] = values[told] & LOW_48, known[of[told]]
            frequent = np.unique(values[order[starts[many]]])
            alone = np.repeat(~many, lengths)
            alone[starts] = True
            keys, values, of = keys[order[alone]], values[order[alone]], of[order[alone]]
            order, cuts, found = cut((values >> np.uint64(16)) % np.uint64(buckets))  # stable: buckets stay in suffix order
            blobs = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                v, (here, local) = values[order[a:b]], np.unique(of[order[a:b]], return_inverse=True)
                rows = np.zeros(b - a, ANCHORED)
                rows["key"], rows["low"], rows["high"], rows["of"] = keys[order[a:b]], v & np.uint64(0xFFFFFFFF), (v >> np.uint64(32)) & np.uint64(0xFFFF), local
                blobs.append(packed_columns(known[here], rows))
            parts = [(-1, found.astype(np.int64).tolist(), blobs)]
            if len(frequent):  # these only pass through the scan, in any of its buckets
                for number, rows in ((-2, distinct(held)), (-3, frequent & LOW_48)):
                    blobs = [rows[a : a + ROWS_A_BLOB].tobytes() for a in range(0, len(rows), ROWS_A_BLOB)]
                    parts.append((number, [spread(ids[0] + i, buckets) for i in range(len(blobs))], blobs))
            rows = _kinds(parts, "level")
            return rows.add_column(0, "batch", pa.array([batch] * rows.num_rows, pa.int32())).to_batches()

        seen = set()  # of copies in one task, one enters: its first document is found later
        for rows in (batch.slice(at, TEXTS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, TEXTS_AT_ONCE)):
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                if doc is None or len(data) < LENGTH or (digest := hashlib.md5(data).digest()) in seen:
                    continue
                seen.add(digest)
                if len(seen) > 500_000:
                    seen.clear()
                some.append((doc, data))
                bytes_taken += len(data)
                if bytes_taken >= BYTES_AT_ONCE:
                    size, bytes_taken = size + take(), 0
                    if max(len(w[3]) for w in waiting.values()) >= 16_384 or size > ENTRIES_AT_ONCE:
                        for number in list(waiting):
                            yield from dealt(number)
                        size = 0
        if some:
            take()
        for number in list(waiting):
            yield from dealt(number)

    return docs.select("doc_id", "text").mapInArrow(sample, f"batch int, level int, {PACKED}")


def packed_columns(table: np.ndarray, rows: np.ndarray) -> bytes:
    """A blob of entries: its table of doc_ids and the columns of ``rows`` one by one, so that sorted keys compress well."""
    import zstandard

    whole = len(table).to_bytes(4, "little") + len(rows).to_bytes(4, "little") + table.astype("<i8").tobytes() + b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in rows.dtype.names)
    return zstandard.ZstdCompressor(level=1).compress(whole)


def opened(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, values of 48 bits, doc_ids) of packed blobs."""
    import zstandard

    keys, values, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for packed in blobs:
        blob = zstandard.ZstdDecompressor().decompress(packed)
        n, m = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
        at, rows = 8 + 8 * n, {}
        for name in kind.names:
            rows[name] = np.frombuffer(blob, kind[name], m, at)
            at += m * kind[name].itemsize
        keys.append(rows["key"].astype(np.uint64))
        values.append(rows["low"].astype(np.uint64) | (rows["high"].astype(np.uint64) << np.uint64(32)))
        docs.append(np.frombuffer(blob, "<i8", n, 8)[rows["of"]])
    return np.concatenate(keys), np.concatenate(values), np.concatenate(docs)


def merge_scan(batch: DataFrame, levels: list[DataFrame], buckets: int, common: int = COMMON) -> DataFrame:
    """Scan a batch's array (level, bucket, entries) against the levels; rows: kind, bucket, entries.

    Kind 0: HELD (anchor, doc) of all anchors that two documents hold, a blob for each bucket. Kind 1: the batch's array as a new
    level, which has each anchor once, with its first document. Kind 2: common anchors.
    """

    def scan(table: pa.Table) -> pa.Table:
        level = np.array(table.column("level"))
        blobs = table.column("entries").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        new = opened([b for b, x in zip(blobs, level, strict=True) if x == -1], ANCHORED)
        old = opened([b for b, x in zip(blobs, level, strict=True) if x >= 0], PLACED)
        keys, values, docs = (np.concatenate(x) for x in zip(new, old, strict=True))
        fresh = np.arange(len(values)) < len(new[1])
        order = suffix_order(keys, values)  # sorted runs are merged
        starts, lengths = runs_of(values[order], keys[order])
        # of the levels alone, what is shared was told before
        told = (lengths > 1) & np.logical_or.reduceat(fresh[order], starts) if len(starts) else np.zeros(0, bool)
        shared = order[np.repeat(told, lengths)]
        held = np.zeros(len(shared), HELD)
        held["value"], held["doc"] = values[shared], docs[shared]
        out = [(0, [bucket], [distinct(held).tobytes()])] if len(held) else []
        for number, kind in ((-2, 0), (-3, 2)):
            passed = [b for b, x in zip(blobs, level.tolist(), strict=True) if x == number]
            out.append((kind, [bucket] * len(passed), passed))
        if (frequent := values[order[starts[lengths > common]]]).size:
            out.append((2, [bucket], [frequent.tobytes()]))
        if len(new[0]):
            out.append((1, [bucket], [_level(*new)]))
        return _kinds(out)

    rows = batch
    for number, level in enumerate(levels):
        rows = rows.unionByName(level.select(F.lit(number).alias("level"), "bucket", "entries"))
    return rows.groupBy("bucket").applyInArrow(scan, "kind int, bucket long, entries binary")


def merge_levels(a: DataFrame, b: DataFrame) -> DataFrame:
    """One level of two, in suffix order: each anchor once, with its first document."""

    def merge(table: pa.Table) -> pa.Table:
        level = _level(*opened(table.column("entries").to_pylist(), PLACED))
        return pa.table({"bucket": table.column("bucket")[:1], "entries": pa.array([level], pa.binary())})

    return a.unionByName(b).groupBy("bucket").applyInArrow(merge, PACKED)


def _level(keys: np.ndarray, values: np.ndarray, docs: np.ndarray) -> bytes:
    """A level's blob of entries that are made of sorted runs: each anchor once, with its first document."""
    order = suffix_order(keys, values)
    starts, _ = runs_of(values[order], keys[order])
    keys, values, docs = keys[order[starts]], values[order[starts]], np.minimum.reduceat(docs[order], starts)
    table, of = np.unique(docs, return_inverse=True)
    rows = np.zeros(len(values), PLACED)
    rows["key"], rows["low"], rows["high"], rows["of"] = keys, values & np.uint64(0xFFFFFFFF), values >> np.uint64(32), of
    return packed_columns(table, rows)


def _kinds(parts: list[tuple[int, list[int], list[bytes]]], name: str = "kind") -> pa.Table:
    kinds = [k for k, found, _ in parts for _ in found]
    return pa.table({name: pa.array(kinds, pa.int32()), "bucket": pa.array([x for _, found, _ in parts for x in found], pa.int64()), "entries": pa.array([x for *_, blobs in parts for x in blobs], pa.binary())})


class Index:
    """The family of levels: [logarithm of the size in batches, table], largest first. ``add`` takes a batch in and keeps
    the rest. Levels of equal size merge when the next batch comes, so nothing is merged that won't be scanned.

    All batches of an index have the same number of buckets.
    """

    def __init__(self, buckets: int, common: int = COMMON):
        self.buckets, self.common, self.levels, self.merges = buckets, common, [], 0

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch (level, bucket, entries of ``sampled_suffixes``); ``merge_scan``'s rows of kinds 0 and 2."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels[-2:]
            self.levels[-2:] = [(size + 1, written(merge_levels(a, b), "level"))]
            discard(a, b)
            self.merges += 1
        spark, path = batch.sparkSession, new_folder(batch.sparkSession, "scanned")
        write(merge_scan(batch, [level for _, level in self.levels], self.buckets, self.common), path, "kind")

        def of_kind(kind: int) -> DataFrame:
            part = f"{path}/kind={kind}"
            rows = spark.read.schema(PACKED).parquet(part) if has_files(spark, part) else spark.createDataFrame([], PACKED)
            rows._written_to = part
            return rows

        self.levels.append((0, of_kind(1)))
        found = of_kind(0).select(F.lit(0).alias("kind"), "bucket", "entries").unionByName(of_kind(2).select(F.lit(2).alias("kind"), "bucket", "entries"))
        found._written_to = path
        return found

    def drop(self) -> None:
        discard(*[level for _, level in self.levels])
        self.levels = []


def shared_anchors(docs: DataFrame, buckets: int, batches: int = BATCHES, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Take the documents into an index batch by batch; (bucket, entries) of HELD: anchors with two documents, and
    (entries): common anchors. Documents are read and sampled once; batches are of about as many documents each."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    bounds = sorted(set(cuts or []))
    path = new_folder(spark, "sampled")
    rows = sampled_suffixes(docs, buckets, bounds, common)
    write(rows, path, "batch")
    index, found = Index(buckets, common), []
    kinds = rows.drop("batch").schema
    for i in range(len(bounds) + 1):
        if has_files(spark, part := f"{path}/batch={i}"):
            batch = spark.read.schema(kinds).parquet(part)
            batch._written_to = part
            found.append(index.add(batch))
            discard(batch)
    index.drop()
    if not found:
        none = spark.createDataFrame([], "kind int, bucket long, entries binary")
        return none.select("bucket", "entries"), none.select("entries")
    every = reduce(DataFrame.unionByName, found)
    return every.where("kind = 0").select("bucket", "entries"), every.where("kind = 2").select("entries")


def common_bits(frequent: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS over anchors, with the bits of the ``frequent`` ones set."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8") % np.uint64(FILTER_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["bit"])

    words = frequent.mapInArrow(bits, "bit long").groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 32, "<u4")
    bitmap[[r["word"] for r in words]] = [r["bits"] for r in words]
    return bitmap


def dealt_by_document(held: DataFrame, kind: np.dtype, documents: int) -> DataFrame:
    """Packed rows of ``kind`` (entries), however they were packed, dealt to ``documents`` buckets by their document.

    A task gathers ROWS_DEALT rows of many blobs before it deals them, so that pieces don't get small as buckets of the index
    and of documents both grow with the corpus.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def dealt() -> pa.RecordBatch:
            rows = distinct(np.concatenate(waiting))
            order, bounds, found = cut(mixed(rows["doc"].astype(np.uint64)) % np.uint64(documents))
            rows = rows[order]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array([rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for blob in batch.column(0):
                waiting.append(np.frombuffer(blob.as_py(), kind))
                size += len(waiting[-1])
                if size >= ROWS_DEALT:
                    yield dealt()
                    size = 0
        if waiting:
            yield dealt()

    return held.select("entries").mapInArrow(deal, PACKED)


def per_document(held: DataFrame, kind: np.dtype, columns: dict[str, str]) -> DataFrame:
    """Packed rows of ``kind`` dealt by document: doc, and an array of longs for each of ``columns`` (name: condition on
    range)."""

    def gather(table: pa.Table) -> pa.Table:
        rows = distinct(np.frombuffer(b"".join(table.column("entries").to_pylist()), kind))
        values = rows[rows.dtype.names[1]].astype(np.uint64).view(np.int64)
        starts, lengths = runs(rows["doc"])
        out = {"doc": pa.array(rows["doc"][starts])}
        for name, which in columns.items():
            chosen = np.ones(len(rows), bool) if which == "" else rows["range"] == int(which)
            counts = np.add.reduceat(chosen, starts) if len(starts) else np.zeros(0, np.int64)
            out[name] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values[chosen]))
        return pa.table(out)

    return held.groupBy("bucket").applyInArrow(gather, "doc long, " + ", ".join(f"{c} array<long>" for c in columns))


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place in the joined bytes, place in the stretch) of all windows of stretches of these ``sizes``."""
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, (np.cumsum(sizes) - sizes)[owner] + within, within


def removed_rows(heads: np.ndarray, owner: np.ndarray, within: np.ndarray, flagged: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """REMOVED of the ``flagged`` windows: ranges, or hashes where it isn't known where their stretches begin."""
    at = np.flatnonzero(flagged)
    lost = heads["start"][owner[at]] == NOWHERE
    rows = np.zeros(int(lost.sum()), REMOVED)
    rows["doc"], rows["value"] = heads["doc"][owner[at[lost]]], hashes[at[lost]]
    at = at[~lost]
    starts, lengths = runs_of(at - np.arange(len(at)), owner[at])
    first = at[starts]
    ranges = np.zeros(len(first), REMOVED)
    ranges["doc"], ranges["range"] = heads["doc"][owner[first]], 1
    ranges["value"] = (heads["start"][owner[first]].astype(np.uint64) + within[first].astype(np.uint64)) << np.uint64(32) | lengths.astype(np.uint64)
    return np.concatenate([rows, ranges])


def whole_stretches(heads: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """REMOVED of all windows of these stretches."""
    known = heads["start"] != NOWHERE
    ranges = np.zeros(int(known.sum()), REMOVED)
    ranges["doc"], ranges["range"] = heads["doc"][known], 1
    ranges["value"] = heads["start"][known].astype(np.uint64) << np.uint64(32) | (heads["size"][known] - np.uint32(LENGTH - 1)).astype(np.uint64)
    out, lost = [ranges], np.flatnonzero(~known)
    for some in slices(heads["size"][lost]):
        sizes = heads["size"][lost[some]].astype(np.int64)
        owner, at, within = windows_of(sizes)
        hashes = byte_hashes(np.frombuffer(b"".join([parts[i] for i in lost[some].tolist()]), np.uint8), LENGTH)[at]
        out.append(removed_rows(heads[lost[some]], owner, within, np.ones(len(at), bool), hashes))
    return np.concatenate(out)


def slices(sizes: np.ndarray, groups: np.ndarray | None = None) -> list[slice]:
    """Slices of rows of these ``sizes``, of about COMPARED_AT_ONCE bytes each; no row of ``groups`` (starts of groups) is cut off its group."""
    ends = np.cumsum(sizes.astype(np.int64))
    whole = np.arange(len(sizes)) if groups is None else groups
    if not len(whole):
        return []
    number = (ends[whole] - sizes[whole]) // COMPARED_AT_ONCE
    cuts = whole[runs(number)[0]].tolist()
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]


def compared(heads: np.ndarray, text: bytes, least: bool) -> tuple[np.ndarray, np.ndarray]:
    """(REMOVED: windows that start in a smaller doc_id of ``heads`` too; LEAST, if asked for: each window with its smallest doc_id).
    ``text`` has the stretches of ``heads`` one after another."""
    data = np.frombuffer(text, np.uint8)
    owner, at, within = windows_of(heads["size"].astype(np.int64))
    hashes = byte_hashes(data, LENGTH)[at]
    docs = heads["doc"][owner]
    order = np.argsort(hashes)
    starts, lengths = runs(hashes[order])
    if not least:  # what occurs once starts nowhere else
        order = order[np.repeat(lengths > 1, lengths)]
    order = order[np.lexsort((docs[order], hashes[order]))]
    starts, lengths = runs(hashes[order])
    leader = np.repeat(order[starts], lengths)
    later = docs[order] > docs[leader]
    chosen, theirs, same = at[order[later]], at[leader[later]], np.zeros(int(later.sum()), bool)
    views = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for a in range(0, len(chosen), 1 << 15):  # hashes only bring windows together; bytes decide
        same[a : a + (1 << 15)] = (views[chosen[a : a + (1 << 15)]] == views[theirs[a : a + (1 << 15)]]).all(axis=1)
    flagged = np.zeros(len(owner), bool)
    flagged[order[later]] = same
    if not same.all():  # windows whose hash is another's: each kind of bytes for itself
        odd = np.isin(hashes, np.unique(hashes[order[later]][~same]))
        smallest: dict[bytes, int] = {}
        for i in np.flatnonzero(odd).tolist():
            window = text[at[i] : at[i] + LENGTH]
            smallest[window] = min(smallest.get(window, docs[i]), docs[i])
        for i in np.flatnonzero(odd).tolist():
            flagged[i] = docs[i] > smallest[text[at[i] : at[i] + LENGTH]]
    held = np.zeros(len(starts) if least else 0, LEAST)
    if least:
        held["doc"], held["value"], held["second"] = docs[order][starts], hashes[order][starts], byte_hashes(data, LENGTH, SECOND_MULTIPLIER)[at[order[starts]]]
    return removed_rows(heads, owner, within, flagged, hashes), held


def judged(heads: np.ndarray, text: bytes, least: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(REMOVED: windows that start in a smaller doc_id of ``heads`` too; LEAST, if asked for: windows with the smallest doc_id of
    those compared at once, to be judged on). ``text`` has the stretches of ``heads`` one after another.

    Of equal stretches the smallest doc_id's is judged, for all windows of the others start in it. Equal windows have the same
    anchor, so a stretch that is the only one left of its anchor has none that another has.
    """
    ends = np.cumsum(heads["size"].astype(np.int64))
    parts = [text[a:b] for a, b in zip((ends - heads["size"]).tolist(), ends.tolist(), strict=True)]
    place: dict[bytes, int] = {}
    of = np.array([place.setdefault(part, i) for i, part in enumerate(parts)], np.int64)
    place.clear()
    order = np.lexsort((heads["doc"], of))
    starts, lengths = runs(of[order])
    first = np.repeat(order[starts], lengths)
    later = order[heads["doc"][order] > heads["doc"][first]]
    removed, found = [whole_stretches(heads[later], [parts[i] for i in later.tolist()])], [np.zeros(0, LEAST)]
    left = order[starts]
    left = left[np.argsort(heads["anchor"][left], kind="stable")]
    starts, lengths = runs(heads["anchor"][left])
    if not least:
        left = left[np.repeat(lengths > 1, lengths)]
        starts, lengths = runs(heads["anchor"][left])
    for some in slices(heads["size"][left], None if least else starts):
        rows, held = compared(heads[left[some]], b"".join([parts[i] for i in left[some].tolist()]), least)
        removed.append(rows)
        found.append(held)
    return np.concatenate(removed), np.concatenate(found)


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of longs of a column, as unsigned numbers."""
    values, ends = np.array(column.flatten()).view(np.uint64), np.array(column.offsets).tolist()
    return [values[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def dealt_stretches(texts: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """From doc, text, anchors, repeated (whether rows share the doc): the different stretches of a pack of documents around these anchors; a row per bucket of
    the pack. ``common``: the bitmap of common anchors.

    stretches: packed by anchor. least: LEAST of windows around common anchors, packed by window hash. removed: REMOVED,
    as far as the pack tells, in one of its rows.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        # by stretch: document, anchor, place; of those left to a smaller doc_id: document, place, number of the stretch
        docs, values, begins, lost_docs, lost_begins, lost_of = columns = [array("q") for _ in range(6)]
        parts, place, size, some, bytes_taken = [], {}, 0, [], 0

        def take() -> int:
            """The stretches of the texts in ``some``; their bytes, about."""
            data, sizes, size = b"".join([t for _, t, _, _ in some]), np.array([len(t) for _, t, _, _ in some]), 0
            ends = np.cumsum(sizes)
            anchors = window_anchors(np.frombuffer(data, np.uint8)) & LOW_48
            new = np.ones(len(anchors), bool)
            new[1:] = anchors[1:] != anchors[:-1]
            new[ends[:-1]] = new[ends[:-1] - (LENGTH - 1)] = True
            starts = np.flatnonzero(new)
            lengths, of = np.diff(np.append(starts, len(anchors))), np.searchsorted(ends, starts, "right")
            wanted = np.concatenate([w | np.uint64(i << 48) for i, (_, _, w, _) in enumerate(some)])
            chosen = np.isin(anchors[starts] | of.astype(np.uint64) << np.uint64(48), wanted) & (starts + LENGTH <= ends[of])
            starts, lengths, of = starts[chosen], lengths[chosen], of[chosen]
            within = starts - (ends - sizes)[of]
            within[np.array([r for *_, r in some])[of]] = NOWHERE
            ids = np.array([d for d, *_ in some])[of].tolist()
            for start, n, value, doc, begin in zip(starts.tolist(), (lengths + LENGTH - 1).tolist(), anchors[starts].tolist(), ids, within.tolist(), strict=True):
                part = data[start : start + n]
                at = place.setdefault(part, len(parts))
                if at == len(parts):
                    docs.append(doc), values.append(value), parts.append(part), begins.append(begin)
                    size += n
                elif doc > docs[at]:  # all its windows start in the smaller doc_id too
                    lost_docs.append(doc), lost_begins.append(begin), lost_of.append(at)
                    size += REMOVED.itemsize
                elif doc < docs[at]:
                    lost_docs.append(docs[at]), lost_begins.append(begins[at]), lost_of.append(at)
                    docs[at], begins[at] = doc, begin
                    size += REMOVED.itemsize
                else:
                    begins[at] = NOWHERE
            some.clear()
            return size

        def dealt() -> pa.RecordBatch:
            heads, anchors = np.zeros(len(parts), STRETCH), np.array(values, np.uint64)
            heads["doc"], heads["size"], heads["start"] = docs, np.fromiter(map(len, parts), np.uint32, len(parts)), begins
            heads["anchor"] = mixed(anchors) >> np.uint64(32)
            at = (anchors % np.uint64(FILTER_BITS)).astype(np.int64)
            often = ((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
            later = heads[np.array(lost_of)]
            later["doc"], later["start"] = lost_docs, lost_begins
            removed = whole_stretches(later, [parts[i] for i in lost_of])
            out, rare = defaultdict(lambda: [None] * 3), np.flatnonzero(~often)

            def put(k: int, found: list[int], blobs: list[bytes]) -> None:
                for bucket, blob in zip(found, blobs, strict=True):
                    out[bucket][k] = blob

            order, bounds, found = cut(mixed(anchors[rare]) % np.uint64(buckets))
            order = rare[order]
            blobs = [(int(b - a)).to_bytes(4, "little") + heads[order[a:b]].tobytes() + b"".join([parts[i] for i in order[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            put(0, found.tolist(), blobs)
            if often.any():
                rows, least = judged(heads[often], b"".join([parts[i] for i in np.flatnonzero(often)]), least=True)
                removed = np.concatenate([removed, rows])
                order, bounds, found = cut(mixed(least["value"]) % np.uint64(buckets))
                least = least[order]
                put(1, found.tolist(), [least[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            if len(removed):  # one blob of the pack, with any of its buckets
                put(2, [list(out)[spread(docs[0], len(out))] if out else spread(docs[0], buckets)], [distinct(removed).tobytes()])
            for column in columns:
                del column[:]
            parts.clear(), place.clear()
            blobs = zip(*out.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *[pa.array(c, pa.binary()) for c in blobs]], ["bucket", "stretches", "least", "removed"])

        for rows in (batch.slice(at, TEXTS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, TEXTS_AT_ONCE)):
            for doc, text, wanted, repeated in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), arrays(rows.column(2)), rows.column(3).to_pylist(), strict=True):
                data = (text or "").encode()
                if len(data) < LENGTH:
                    continue
                some.append((doc, data, wanted, repeated))
                bytes_taken += len(data)
                if bytes_taken >= BYTES_AT_ONCE:
                    size, bytes_taken = size + take(), 0
                    if size > 16_000_000:
                        yield dealt()
                        size = 0
        if some:
            take()
        if parts:
            yield dealt()

    return texts.mapInArrow(deal, "bucket long, stretches binary, least binary, removed binary")


def verified(dealt: DataFrame) -> DataFrame:
    """The windows that start in a smaller doc_id too; a blob of REMOVED for each bucket."""

    def verify(table: pa.Table) -> pa.Table:
        heads, texts = [], []
        for blob in table.column("stretches").drop_null().to_pylist():
            n = int.from_bytes(blob[:4], "little")
            heads.append(np.frombuffer(blob, STRETCH, n, 4))
            texts.append(blob[4 + n * STRETCH.itemsize :])
        least = [np.frombuffer(b, LEAST) for b in table.column("least").drop_null().to_pylist()]
        removed = [np.frombuffer(b, REMOVED) for b in table.column("removed").drop_null().to_pylist()]
        if heads:
            removed.append(judged(np.concatenate(heads), b"".join(texts))[0])
        if least:
            held = np.concatenate(least)
            held = held[np.lexsort((held["doc"], held["second"], held["value"]))]
            starts, lengths = runs_of(held["value"], held["second"])
            held = held[held["doc"] > np.repeat(held["doc"][starts], lengths)]
            rows = np.zeros(len(held), REMOVED)
            rows["doc"], rows["value"] = held["doc"], held["value"]
            removed.append(rows)
        found = distinct(np.concatenate([np.zeros(0, REMOVED), *removed]))
        return pa.table({"bucket": table.column("bucket")[:1], "entries": pa.array([found.tobytes()], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(verify, PACKED)


def dealt_candidates(docs: DataFrame, texts: DataFrame, buckets: int, batches: int = BATCHES, common: int = COMMON) -> DataFrame:
    """What is to be verified, dealt out: dealt_stretches of the documents that hold shared anchors. ``texts``: whole_texts."""
    shared, frequent = shared_anchors(docs, buckets, batches, common)
    held = per_document(dealt_by_document(shared, HELD, document_buckets(buckets)), HELD, {"anchors": ""})
    firsts = texts.where("first is not null").select(F.col("doc_id").alias("at"), "first").distinct()
    held = held.hint("merge").join(firsts, F.col("doc") == F.col("at")).groupBy("first").agg(F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"))
    repeated = texts.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("at"), F.lit(True).alias("repeated"))
    held = held.join(repeated.hint("merge"), F.col("first") == F.col("at"), "left").select("first", "anchors", F.coalesce("repeated", F.lit(False)).alias("repeated"))
    held = written(held, "held")
    chosen = passing(docs.select("doc_id", "text"), held.select(F.col("first").alias("doc_id")))
    chosen = chosen.join(held.hint("merge"), F.col("first") == F.col("doc_id")).select(F.col("first").alias("doc"), "text", "anchors", "repeated")
    return dealt_stretches(chosen, buckets, common_bits(frequent))


def kept_bytes(data: bytes, windows: np.ndarray, ranges: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept) of a text without the windows that have these hashes and these ranges of them."""
    array = np.frombuffer(data, np.uint8)
    step = np.zeros(len(data) + 1, np.int64)
    if len(windows):
        flagged = np.isin(byte_hashes(array, LENGTH), windows)
        step[: len(flagged)] += flagged
        step[LENGTH : LENGTH + len(flagged)] -= flagged
    starts = (ranges >> np.uint64(32)).astype(np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + (ranges & np.uint64(0xFFFFFFFF)).astype(np.int64) + (LENGTH - 1), -1)
    gone = np.cumsum(step[:-1]) > 0
    return int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), array[~gone].tobytes()


def remove_repeats(docs: DataFrame, batches: int = BATCHES, common: int = COMMON) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (its bytes; null where
    nothing or all is removed).

    A byte is removed if a LENGTH-byte string over it also starts in a document with a smaller doc_id; strings are judged
    on the input. Null texts count as empty; texts under LENGTH bytes and null doc_ids keep all; rows that repeat a
    doc_id are judged against smaller doc_ids only; an empty table gives no rows; other columns are ignored.
    """
    texts = whole_texts(docs)
    plain = docs.select("doc_id", "text")
    buckets = buckets_for(texts.agg(F.sum("n_bytes")).first()[0] or 0)
    dealt = dealt_candidates(docs, texts, buckets, batches, common)
    told = dealt_by_document(verified(dealt), REMOVED, document_buckets(buckets))
    removed = written(per_document(told, REMOVED, {"windows": "0", "ranges": "1"}), "removed")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, windows, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrays(batch.column(2)), arrays(batch.column(3)), strict=True):
                data = text.encode()
                n, spans, kept = kept_bytes(data, windows, ranges)
                rows.append((doc, n, spans, hashlib.sha256(data).hexdigest(), hashlib.sha256(kept).hexdigest(), kept))
            names = ["cut_id", "cut_removed", "cut_spans", "cut_from", "cut_sha256", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names)

    cut_texts = passing(plain, removed.select(F.col("doc").alias("doc_id"))).join(removed.hint("merge"), F.col("doc_id") == F.col("doc"))
    done = cut_texts.where(f"octet_length(text) >= {LENGTH}").select("doc_id", "text", "windows", "ranges").mapInArrow(finish, "cut_id long, cut_removed long, cut_spans long, cut_from string, cut_sha256 string, kept binary")
    done = done.dropDuplicates(["cut_id", "cut_from"])
    again = F.col("first").isNotNull() & (F.col("doc_id") > F.col("first"))
    out = texts.join(done.hint("merge"), (F.col("doc_id") == F.col("cut_id")) & (F.col("sha256") == F.col("cut_from")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("cut_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(again, F.lit(1)).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(again, nothing).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
        F.when(~again, F.col("kept")).alias("kept"),
    )
