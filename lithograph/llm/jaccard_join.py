"""Set-similarity join of documents by PartEnum signatures (operator 7).

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold T. PartEnum turns this into
equality of signatures without losing a pair:

* Sizes are cut into bands whose ends differ by the factor 1 / T at most; a set of band b signs for the windows b and
  b + 1, so two sets similar enough always sign for a window together.
* In a window, the shingle domain is split into parts by hash. Two similar sets differ in at most
  d = (1 - T) / (1 + T) * (|r| + |s|) shingles, so in at most d parts. There are enough parts for a set to fill more
  than d; enumerating the subsets that leave out as many parts as may differ leaves the single parts, and a signature is
  the hash of the shingles in a part. A set that fills f parts agrees with a similar one in f - d of them at least.
* So a set may leave out its f - d - 1 most frequent signatures: of those that agree, the rarest is left in both. Texts
  that merely quote the same passage thereby lose all they share, while copies keep most of it. A set that doesn't fill
  more than d parts (which takes a freak of hashing) also signs with a value that all such sets of the window share.

Texts with equal sets form a class, and classes are compared once. In a signature's group the smallest class leads and
is compared with each member: a star, not all pairs. Members that links then join need no more comparing for the
components; where a group's members still lie in different components, all that such groups connect is compared again,
in blocks of bounded size that give only the links found. What is compared is compared on the whole sets. Signatures travel packed, as one binary per task and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bitmap_of, hits, partitions, salted_join, without, written
from .text_stats import WordHashes, mixed, shingles

#: The threshold as a fraction.
THRESHOLD = (75, 100)
#: Parts of a window per shingle of its largest set, and at least.
PARTS_PER_SHINGLE, LEAST_PARTS = 0.4, 64
#: Shingles and classes of a chunk in the second round, which bound the memory of a task, and rows compared at once.
CHUNK, CHUNK_CLASSES, ROWS_AT_ONCE, ELEMENTS_AT_ONCE = 300_000, 8192, 512, 2048


def shingle_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the k-word shingles of a text, A-Z lower-cased."""
    return np.unique(shingles(hashes.of((text or "").encode().lower().split()), k))  # bytes: ASCII white space and letters only


def class_key(values: np.ndarray) -> int:
    """Identity of a set: 64 bits over its sorted hashes (never 0)."""
    import xxhash

    return xxhash.xxh3_64_intdigest(values.tobytes()) >> 1 | 1


def bands(n: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(band of each size, largest size of every band up to one more than needed): l to l * den // num, without gaps."""
    ends, low, top = [], 1, int(n.max(initial=1))
    while not ends or ends[-1] < top or len(ends) < 2:
        ends.append(low * threshold[1] // threshold[0])
        low = ends[-1] + 1
    ends.append(low * threshold[1] // threshold[0])
    ends = np.array(ends)
    return np.searchsorted(ends, n), ends


def parts_of(largest: int) -> int:
    return max(LEAST_PARTS, int(largest * PARTS_PER_SHINGLE) + 1)


def may_differ(n: np.ndarray, largest: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Shingles in which a set of size n and any similar one of up to ``largest`` may differ."""
    num, den = threshold
    return (den - num) * (n + np.minimum(n * den // num, largest)) // (den + num)


def signatures(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of its set, window 0 or 1 of the set) of all sets, and slack[set, window]: how many of a
    set's signatures in a window may be left out."""
    n = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    band, ends = bands(n, threshold)
    spread = mixed(values ^ np.uint64(0x5851F42D4C957F2D))
    parts = np.array([parts_of(int(e)) for e in ends], np.uint64)
    out, slack = [], np.zeros((len(sets), 2), np.int64)
    for window in (0, 1):
        tag = band + window
        # values ascend within a set, so parts do, and each is one run
        part = ((values >> np.uint64(32)) * parts[tag][owner]) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
        of = owner[starts]
        seed = mixed(tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        signature = mixed(np.add.reduceat(spread, starts) + mixed(part[starts] + np.uint64(1)) + seed[of])
        slack[:, window] = np.bincount(of, minlength=len(sets)) - 1 - may_differ(n, ends[tag], threshold)
        few = np.flatnonzero(slack[:, window] < 0)
        out.append((np.concatenate([signature, seed[few]]), np.concatenate([of, few]), np.full(len(of) + len(few), window)))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), np.maximum(slack, 0)


ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("of", "<u2")])
SIGNER = np.dtype([("class", "<i8"), ("slack", "<u4", 2)])
SHARED = np.dtype([("class", "<i8"), ("signature", "<u8"), ("n", "<u4"), ("slack", "<u4"), ("window", "u1")])
MEMBER = np.dtype([("signature", "<u8"), ("class", "<i8")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
PACKED = "bucket long, entries binary"
#: Classes that a task packs at once; an entry has 15 bits for them.
CLASSES_AT_ONCE = 4096


def cut(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bounds of the buckets in it, buckets)."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    bounds = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.int64)
    return order, bounds, ordered[bounds[:-1]]


def packed(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order, bounds, buckets = cut(bucket)
    rows = rows[order]
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array([rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["bucket", "entries"])


def unpacked(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("entries").to_pylist()), kind)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (0: no words) of every document; equal sets have the same class."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, hashes)
                n.append(len(s))
                keys.append(class_key(s) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "class"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_shingles long, class long")


def dealt_signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """All signatures, packed by bucket; a task signs a class once. An entry has 48 bits of the signature, the signer
    and its window; the bucket has the others."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, fresh = WordHashes(), set(), {}

        def dealt() -> pa.RecordBatch:
            signature, of, window, slack = signatures(list(fresh.values()))
            signers = np.zeros(len(fresh), SIGNER)
            signers["class"], signers["slack"] = list(fresh), slack
            entries = np.zeros(len(signature), ENTRY)
            entries["low"], entries["high"] = signature & np.uint64(0xFFFFFFFF), (signature >> np.uint64(32)) & np.uint64(0xFFFF)
            order, bounds, found = cut((signature >> np.uint64(40)) % np.uint64(buckets))
            blobs = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rows = entries[order[a:b]]
                here, local = np.unique(of[order[a:b]], return_inverse=True)
                rows["of"] = local.astype(np.uint16) | (window[order[a:b]].astype(np.uint16) << np.uint16(15))
                blobs.append(len(here).to_bytes(4, "little") + signers[here].tobytes() + rows.tobytes())
            fresh.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        waiting = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, hashes)
                if len(s) and (key := class_key(s)) not in seen:
                    seen.add(key)
                    fresh[key] = s
                    waiting += len(s)
                    if len(fresh) >= CLASSES_AT_ONCE or waiting > 2_000_000:
                        yield dealt()
                        waiting = 0
            if len(seen) > 500_000:
                seen.clear()
        if fresh:
            yield dealt()

    return docs.select("text").mapInArrow(sign, PACKED)


def shared_signatures(dealt: DataFrame, buckets: int) -> DataFrame:
    """Of a bucket's signatures those that two classes or more have, with their number, packed by class."""

    def count(table: pa.Table) -> pa.Table:
        signature, keys, slack, window = [], [], [], []
        for blob in table.column("entries").to_pylist():
            n = int.from_bytes(blob[:4], "little")
            signers = np.frombuffer(blob, SIGNER, n, 4)
            rows = np.frombuffer(blob, ENTRY, -1, 4 + n * SIGNER.itemsize)
            of, side = (rows["of"] & 0x7FFF).astype(np.int64), (rows["of"] >> 15).astype(np.int64)
            signature.append(rows["low"].astype(np.uint64) | (rows["high"].astype(np.uint64) << np.uint64(32)))
            keys.append(signers["class"][of])
            slack.append(signers["slack"][of, side])
            window.append(side.astype(np.uint8))
        signature, keys, slack, window = map(np.concatenate, (signature, keys, slack, window))
        order = np.argsort(signature, kind="stable")
        starts, lengths = runs(signature[order])
        order = order[np.repeat(lengths, lengths) > 1]  # from here on, few
        order = order[np.lexsort((keys[order], signature[order]))]
        same = np.concatenate([[False], (signature[order][1:] == signature[order][:-1]) & (keys[order][1:] == keys[order][:-1])]) if len(order) else np.zeros(0, bool)
        order = order[~same]
        starts, lengths = runs(signature[order])
        number = np.repeat(lengths, lengths)
        order, number = order[number > 1], number[number > 1]
        rows = np.zeros(len(order), SHARED)
        for name, column in (("class", keys), ("signature", signature), ("slack", slack), ("window", window)):
            rows[name] = column[order]
        rows["n"] = np.minimum(number, 0xFFFFFFFF)
        return pa.Table.from_batches([packed(rows, mixed(rows["class"].view(np.uint64)) % np.uint64(buckets))])

    return dealt.groupBy("bucket").applyInArrow(count, PACKED)


def kept_signatures(shared: DataFrame, buckets: int) -> DataFrame:
    """Leave out as many of a class's most frequent signatures of a window as it may; the rest, packed by signature."""

    def keep(table: pa.Table) -> pa.Table:
        rows = unpacked(table, SHARED)
        rows = rows[np.lexsort((rows["signature"], rows["n"], rows["window"], rows["class"]))]
        starts, lengths = runs(rows["class"] * 2 + rows["window"]) if len(rows) else runs(np.zeros(0))
        rank = np.arange(len(rows)) - np.repeat(starts, lengths)
        rows = rows[rank < np.repeat(lengths, lengths) - rows["slack"].astype(np.int64)]
        kept = np.zeros(len(rows), MEMBER)
        kept["signature"], kept["class"] = rows["signature"], rows["class"]
        return pa.Table.from_batches([packed(kept, mixed(kept["signature"]) % np.uint64(buckets))])

    return shared.groupBy("bucket").applyInArrow(keep, PACKED)


def grouped(kept: DataFrame) -> DataFrame:
    """signature, class for the groups of two or more, each different group once (the smallest of its signatures)."""

    def group(table: pa.Table) -> pa.Table:
        rows = np.unique(unpacked(table, MEMBER))  # by signature, then class
        starts, lengths = runs(rows["signature"])
        whole = np.add.reduceat(mixed(rows["class"].view(np.uint64)), starts) if len(rows) else np.zeros(0, np.uint64)
        first = np.zeros(len(starts), bool)
        first[np.unique(whole, return_index=True)[1]] = True
        stay = np.repeat(first & (lengths > 1), lengths)
        group = np.repeat(mixed(whole), lengths)[stay]  # named by its members, so that other tasks give it the same name
        return pa.table({"group": pa.array(group.view(np.int64)), "class": pa.array(rows["class"][stay])})

    return kept.groupBy("bucket").applyInArrow(group, "group long, class long").distinct()


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, members (the sorted hashes as longs) for ``wanted`` (class, doc_id).

    A bitmap lets most other documents go before anything is shuffled; the join then is exact.
    """
    bitmap = bitmap_of(wanted, F.xxhash64("doc_id"))
    sent, size = docs.sparkSession.sparkContext.broadcast(bitmap.words), bitmap.bits

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = np.flatnonzero(hits(sent.value, np.array(batch.column(2))))
            for some in np.array_split(rows, len(rows) // 256 + 1):
                if len(some):
                    chosen = batch.take(pa.array(some))
                    found = [shingle_set(t, hashes).view(np.int64) for t in chosen.column(1).to_pylist()]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]), pa.int32()), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([chosen.column(0), lists], ["doc_id", "members"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    passed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("bit")).mapInArrow(sets, f"doc_id {kind}, members array<long>")
    return passed.join(wanted.hint("merge"), wanted["doc_id"].eqNullSafe(passed["doc_id"])).select("class", "members")


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """a, b, shared, union of the ``pairs`` (a, b: classes) that reach the threshold. ``firsts``: class, doc_id, n_shingles."""
    num, den = THRESHOLD
    sizes = firsts.select("class", "n_shingles")
    sized = pairs.hint("merge").join(sizes.toDF("a", "n_a"), "a").hint("merge").join(sizes.toDF("b", "n_b"), "b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    sized = written(sized, "pairs")
    wanted = sized.select(F.explode(F.array("a", "b")).alias("class")).distinct().hint("merge").join(firsts, "class").select("class", "doc_id")
    sets = written(class_sets(docs, written(wanted, "wanted")), "sets")
    met = sized.hint("merge").join(sets.toDF("b", "set_b"), "b").hint("merge").join(sets.toDF("a", "set_a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    met = met.select("a", "b", "n_a", "n_b", shared.alias("shared")).withColumn("union", F.col("n_a") + F.col("n_b") - F.col("shared"))
    return met.where(den * F.col("shared") >= num * F.col("union")).select("a", "b", "shared", "union")


def split_groups(groups: DataFrame, joined: DataFrame) -> DataFrame:
    """group, class, component of the groups whose members lie in different components."""
    placed = groups.join(joined, groups["class"] == joined["node"], "left").select("group", "class", F.coalesce("component", "class").alias("component"))
    ends = placed.groupBy("group").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("group")
    return salted_join(placed, ends, "group", "class")


def dealt_blocks(split: DataFrame, firsts: DataFrame) -> DataFrame:
    """class, component, cluster, low, high, chunk: every class with all that it may still link to.

    Classes that groups connect form a cluster. A cluster is cut by hash into chunks of about CHUNK shingles and
    CHUNK_CLASSES classes at most, and each pair of chunks (low <= high) is a block of its own, so a block's size doesn't
    grow with the cluster's.
    """
    lead = split.groupBy("group").agg(F.min("class").alias("a"))
    cluster = connected_components(salted_join(split, lead, "group", "class").select("a", F.col("class").alias("b"))).withColumnRenamed("component", "cluster")
    members = split.select("class", "component").distinct().join(cluster, F.col("class") == F.col("node")).join(firsts.select("class", "n_shingles"), "class")
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n_shingles") / CHUNK, F.count(F.lit(1)) / CHUNK_CLASSES)).cast("int").alias("chunks"))
    placed = salted_join(members, sizes, "cluster", "class").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return placed.select("class", "component", "cluster", "chunk", other).select("class", "component", "cluster", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk")


def compared_blocks(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared, union of the linked pairs of each block that lie in different components."""
    num, den = THRESHOLD

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        classes, parts, chunk = (np.array(table.column(c)) for c in ("class", "component", "chunk"))
        lists = table.column("members").chunk(0)
        n, values = np.diff(np.array(lists.offsets)), np.array(lists.flatten())
        owner = np.repeat(np.arange(len(n)), n)
        low, high = key[1].as_py(), key[2].as_py()
        rows, columns = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        column_place = np.full(len(n), -1)
        column_place[columns] = np.arange(len(columns))
        order = np.argsort(values, kind="stable")
        starts, lengths = runs(values[order])
        element = np.repeat(np.cumsum(lengths > 1) - 1, lengths)[np.repeat(lengths > 1, lengths)]
        holder = owner[order][np.repeat(lengths > 1, lengths)]
        tops = np.searchsorted(element, np.arange(0, (int(element[-1]) + 1 if len(element) else 0) + ELEMENTS_AT_ONCE, ELEMENTS_AT_ONCE))
        found = [[] for _ in range(4)]
        for first in range(0, len(rows), ROWS_AT_ONCE):
            mine = rows[first : first + ROWS_AT_ONCE]
            place = np.full(len(n), -1)
            place[mine] = np.arange(len(mine))
            shared = np.zeros((len(mine), len(columns)), np.float32)
            for number, (x, y) in enumerate(zip(tops[:-1], tops[1:], strict=True)):  # elements that two sets hold, some at a time
                holders, at = holder[x:y], element[x:y] - number * ELEMENTS_AT_ONCE
                here = place[holders] >= 0
                if not here.any():
                    continue
                left, right = np.zeros((len(mine), ELEMENTS_AT_ONCE), np.float32), np.zeros((len(columns), ELEMENTS_AT_ONCE), np.float32)
                left[place[holders[here]], at[here]] = 1
                other = column_place[holders] >= 0
                right[column_place[holders[other]], at[other]] = 1
                shared += left @ right.T
            shared = np.rint(shared).astype(np.int64)
            union = n[mine][:, None] + n[columns][None, :] - shared
            linked = (den * shared >= num * union) & (parts[mine][:, None] != parts[columns][None, :])
            if low == high:
                linked &= np.arange(len(columns))[None, :] > first + np.arange(len(mine))[:, None]
            i, j = np.nonzero(linked)
            for column, more in zip(found, (classes[mine][i], classes[columns][j], shared[i, j], union[i, j]), strict=True):
                column.append(more)
        a, b, shared, union = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "shared": pa.array(shared), "union": pa.array(union)})

    met = blocks.join(sets, "class")
    return met.groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long, shared long, union long")


def similarity_join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, n_shingles, class; links: a, b, shared, union between classes).

    The links are enough for all components: within a component that others join, further links aren't listed.
    """
    buckets = 2 * partitions(docs.sparkSession)
    member = written(classes(docs), "classes")
    firsts = written(member.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles")), "firsts")
    kept = kept_signatures(shared_signatures(dealt_signatures(docs, buckets), buckets), buckets)
    groups = written(grouped(kept), "groups")
    lead = groups.groupBy("group").agg(F.min("class").alias("a"))
    stars = salted_join(groups, lead, "group", "class").where("class <> a").select("a", F.col("class").alias("b")).distinct()
    links = written(verified(docs, stars, firsts), "links")
    split = written(split_groups(groups, connected_components(links.select("a", "b"))), "split")
    if not split.isEmpty():
        wanted = written(split.select("class").distinct().join(firsts, "class").select("class", "doc_id"), "wanted")
        links = links.unionByName(written(compared_blocks(dealt_blocks(split, firsts), class_sets(docs, wanted)), "links"))
    return member, links


def components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included).

    A document's set is its distinct 5-word shingles; with fewer words, the whole sequence as one shingle; without words
    or text (null), empty and linked with nothing. Two documents link when 100 * intersection >= 75 * union, so equal
    sets link. Repeated rows give repeated results; a document with a null doc_id takes part, but nulls aren't the
    smallest of others; an empty table gives no rows; other columns are ignored.
    """
    member, links = similarity_join(docs)
    joined = connected_components(links.select("a", "b")).withColumnRenamed("node", "class")
    # a class or a component may have a third of all documents
    placed = salted_join(member, joined, "class", "doc_id", "left").withColumn("_in", F.coalesce("component", "class"))
    least = placed.where("class <> 0").groupBy("_in").agg(F.min("doc_id").alias("component_id"))
    out = salted_join(placed, least, "_in", "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component, with all their columns.

    Rows that repeat a doc_id and its text count once; rows with a null doc_id stay.
    """
    told = written(components(docs), "components")
    gone = written(told.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    repeated = written(told.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    key, same = (lambda df: F.xxhash64(df["doc_id"])), (lambda rows, ids: rows["doc_id"] == ids["_gone_doc_id"])
    stay = without(docs, gone, key, same)
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, stay["doc_id"] == repeated["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return without(stay, repeated, key, same).unionByName(once.select(docs.columns))
