"""Similarity join, repeats, decontamination, sharding, mixing and counts against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lithograph.llm import decontamination, jaccard_join, mixing, queries, sharding, suffix_index, weak_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * (n := len(a & b)) >= 75 * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets) if d is not None)


def family(seed, n=120):
    """Texts with near copies on both sides of the threshold, chains of copies, shared passages and repeats."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    while len(texts) < n:
        words = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 20, 60, 200]))
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words) + 1), passage)
        texts.append(" ".join(words))
        copy = list(words)
        for _ in range(rng.randrange(8)):  # a chain: each a few edits from the last
            copy = list(copy)
            for _ in range(rng.randrange(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts[3] = texts[0].upper()
    texts[5] = None
    texts[6] = " \n"
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(make, seed):
    texts = family(seed)
    got = sorted(tuple(r) for r in jaccard_join.components(make(texts)).collect())
    assert got == slow_components(list(enumerate(texts)))


def test_components_of_the_small_table(spark, sf):
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op7_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect()) == slow_components(rows)


def test_components_of_odd_rows(odd):
    got = sorted((tuple(r) for r in jaccard_join.components(odd).collect() if r["doc_id"] is not None))
    assert got == slow_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 7]


def slow_repeats(rows):
    """n_bytes, n_removed, n_spans, kept_sha256 per row, all by the definition."""
    first, data = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5, 8])
def test_repeats_equal_brute_force(make, batches):
    rng = random.Random(batches)
    letters = "abcde é"
    passages = ["".join(rng.choices(letters, k=k)) for k in (49, 50, 51, 80, 300)]
    texts = ["".join(rng.choice([*passages, "".join(rng.choices(letters, k=rng.randrange(80)))]) for _ in range(rng.randrange(6))) for _ in range(150)]
    texts += [texts[0], None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 200, texts[1] + "!"]
    docs = make(texts)
    got = suffix_index.remove_repeats(docs, batches).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == slow_repeats(list(enumerate(texts)))


def test_repeats_of_the_small_table(spark, sf):
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    got = queries.op10_suffix_index(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == slow_repeats(rows)


def test_repeats_of_odd_rows(odd):
    got = Counter(tuple(r) for r in suffix_index.remove_repeats(odd).select("doc_id", "n_removed").collect())
    assert got[(0, 0)] == got[(1, 0)] == got[(4, 0)] == 1 and got[(5, 0)] == 2 and sum(got.values()) == odd.count()


def test_texts_of_a_batch_are_taken_by_a_few():
    """A task holds a batch's texts as Arrow hands them over, not all of them as strings besides."""
    import tracemalloc

    import pyarrow as pa

    from lithograph.llm import suffix_index

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            return f

    sample = suffix_index.sampled_suffixes(Rows(), 16, [])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(["many words of a text " * 500] * 4000)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        made = sum(r.num_rows for r in sample(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made and batch.nbytes > 40e6 and peak < 20e6


def test_index_levels_are_suffix_arrays_that_merge(make):
    """Batches leave levels of distinct sizes; each bucket is in the order of its suffixes' first bytes; a kept index
    tells of a later batch what it shares with earlier ones."""
    rng = random.Random(3)
    letters = "abcdefgh "
    passage = "".join(rng.choices(letters, k=60))
    texts = ["".join(rng.choices(letters, k=120)) for _ in range(70)]
    texts[3] += passage
    texts[66] = passage + texts[66]
    docs = make(texts)
    index, told = suffix_index.Index(16), []
    for i in range(0, 70, 10):
        batch = suffix_index.sampled_suffixes(docs.where(f"doc_id between {i} and {i + 9}"), 16, []).drop("batch")
        told.append(suffix_index.per_document(suffix_index.dealt_by_document(index.add(batch).where("kind = 0"), suffix_index.HELD, 16), suffix_index.HELD, {"anchors": ""}).collect())
    assert [size for size, _ in index.levels] == [2, 1, 0] and index.merges == 4
    assert {r["doc"] for r in told[-1]} >= {3, 66} and not any(told[:-1])
    entries = 0
    for _, level in index.levels:
        for r in level.collect():
            keys, values, _ = suffix_index.opened([bytes(r["entries"])], suffix_index.PLACED)
            pairs = list(zip(keys.tolist(), values.tolist(), strict=True))
            assert pairs == sorted(set(pairs))
            entries += len(pairs)
    want = set()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        keys, values = suffix_index.suffix_entries(data)
        want |= set(zip(keys.tolist(), (values & suffix_index.LOW_48).tolist(), strict=True))
        places = suffix_index.sampled_places(suffix_index.byte_hashes(data, suffix_index.ANCHOR)).tolist()
        assert all(int.from_bytes(t.encode()[p : p + 8], "big") == k for p, k in zip(places, keys.tolist(), strict=True))
    assert entries >= len(want)


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_index, "byte_hashes", lambda data, k, multiplier=0: np.zeros(len(data) - k + 1, np.uint64))
    texts = [(1, b"a" * 50), (2, b"b" * 50), (3, b"a" * 50), (4, b"b" * 49 + b"c")]
    heads = np.zeros(4, suffix_index.STRETCH)
    heads["doc"], heads["size"] = [d for d, _ in texts], 50
    assert suffix_index.judged(heads, b"".join(t for _, t in texts))[0]["doc"].tolist() == [3]


def test_stretches_are_compared_a_few_at_a_time(monkeypatch):
    """Of equal stretches one is hashed, of those alone at their anchor none, and never all of a bucket at once."""
    rng = random.Random(1)
    hashed, plain = [], suffix_index.byte_hashes
    monkeypatch.setattr(suffix_index, "byte_hashes", lambda data, *a: hashed.append(len(data)) or plain(data, *a))
    other = ["".join(rng.choices("abcdefgh ", k=100)).encode() for _ in range(30_000)]
    texts = [*other, *other[:10_000], *(b"!" + t[1:] for t in other[:15_000])]
    heads = np.zeros(len(texts), suffix_index.STRETCH)
    heads["doc"], heads["size"] = range(len(texts)), 100
    heads["anchor"] = [*range(30_000), *range(10_000), *range(15_000)]
    rows = suffix_index.judged(heads, b"".join(texts))[0]
    assert max(hashed) <= suffix_index.COMPARED_AT_ONCE + 200 and sum(hashed) == 2 * 15_000 * 100
    assert sorted(rows["doc"].tolist()) == list(range(30_000, 55_000)) and rows["range"].all()
    ranges = dict(zip(rows["doc"].tolist(), rows["value"].tolist(), strict=True))
    assert all(ranges[d] == 51 for d in range(30_000, 40_000)) and all(ranges[d] == 1 << 32 | 50 for d in range(40_000, 55_000))


@pytest.mark.parametrize("common", [8, 1000])
def test_repeats_within_texts_and_of_shared_ids_equal_brute_force(spark, common):
    """A stretch that is several times in one text, or in one of the rows of a doc_id, is removed where it stands."""
    rng = random.Random(common)
    lines = ["".join(rng.choices("abcdefgh ", k=k)) for k in (55, 70, 120, 200)]
    rows = []
    for i in range(60):
        parts = [x for line in rng.sample(lines, 2) for x in ["".join(rng.choices("abcdefgh ", k=40)), line] * rng.randrange(1, 4)]
        rows.append((i // 2 if i % 5 == 0 else i, "".join(parts)))
    rows += [(3, rows[3][1]), (4, rows[7][1] + "z"), (5, rows[8][1]), (-1, lines[1] + lines[2][:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_index.remove_repeats(docs, 3, common).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == slow_repeats(rows)


def test_suffix_order_merges_sorted_runs():
    rng = np.random.default_rng(5)
    keys, values = rng.integers(0, 300, 4000).astype(np.uint64), rng.integers(0, 50, 4000).astype(np.uint64)
    cuts = [0, 7, 900, 2500, 4000]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        order = np.lexsort((values[a:b], keys[a:b]))
        keys[a:b], values[a:b] = keys[a:b][order], values[a:b][order]
    assert suffix_index.suffix_order(keys, values).tolist() == np.lexsort((values, keys)).tolist()
    assert not len(suffix_index.suffix_order(keys[:0], values[:0]))


def test_entries_of_joined_texts_are_those_of_each():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abc ", k=k)).encode() for k in (50, 51, 400, 50, 90, 3000)]
    keys, values, of = suffix_index.entries_of(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    for i, text in enumerate(texts):
        want = suffix_index.suffix_entries(np.frombuffer(text, np.uint8))
        assert [x.tolist() for x in want] == [keys[of == i].tolist(), values[of == i].tolist()]


def hot_passage(n=400):
    """A passage of 50 bytes in every document, each time between other letters."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choices(letters, k=50))
    return ["".join(rng.choices(letters, k=30)) + passage + "".join(rng.choices(letters, k=30)) for _ in range(n)]


@pytest.mark.parametrize("batches", [1, 2])
def test_repeats_of_a_hot_passage_equal_brute_force(make, batches):
    texts = hot_passage(200)
    texts += [texts[3], texts[4][:70] + "z" + texts[4], texts[5][10:], texts[6] + texts[7]]
    docs = make(texts).repartition(3)
    got = suffix_index.remove_repeats(docs, batches, common=8).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == slow_repeats(list(enumerate(texts)))


def test_repeats_of_a_hot_passage_are_dealt_over_tasks(make):
    docs = make(hot_passage()).repartition(3)
    dealt = suffix_index.dealt_candidates(docs, suffix_index.whole_texts(docs), 16, 2, common=40)
    sizes = Counter()
    for r in dealt.collect():
        sizes[r["bucket"]] += sum(len(r[c] or b"") for c in ("stretches", "least", "removed"))
    assert len(sizes) == 16 and max(sizes.values()) < 3 * sum(sizes.values()) / 16


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    told = con.execute(queries.SQL[name])
    names = [c[0] for c in told.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(told.fetchall(), key=str) == sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)


def slow_similar(text, item):
    """Greatest similarity of an item-sized window and the item: sum of minima / sum of maxima of shingle counts."""
    words, wanted = WORD.findall(lowered(text)), WORD.findall(lowered(item))
    if not words or not wanted:
        return Fraction(0)
    k = min(5, len(wanted))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    target, best = grams(wanted), Fraction(0)
    for i in range(max(1, len(words) - len(wanted) + 1)):
        window = grams(words[i : i + len(wanted)])
        if window:
            best = max(best, Fraction(sum((window & target).values()), sum((window | target).values())))
    return best


def test_contaminated_equals_brute_force(spark, make):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=k)) for k in (3, 8, 20, 40, 60, 120)] + ["", None, "la la la la la la la la la la"]
    texts = [None, "", "la " * 40]
    for _ in range(150):
        words = rng.choices(vocabulary, k=rng.randrange(1, 150))
        passage = (rng.choice(items) or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if passage:
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        at = rng.randrange(len(words))
        texts.append(" ".join(words[:at] + passage + words[at:]).title())
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(make(texts), benchmark).collect()}
    slow = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items) if (s := slow_similar(t, item)) >= Fraction(3, 4)}
    assert got.keys() == slow.keys() and len(got) > 40
    assert all(math.isclose(got[k], slow[k]) for k in got)


def test_contaminated_of_odd_rows(spark, odd):
    benchmark = spark.createDataFrame([(0, "same five words and more"), (1, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd, benchmark).collect()} == {(5, 0), (6, 0)}
    kept = decontamination.without_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 7, None}
    assert decontamination.contaminated(odd, benchmark.limit(0)).count() == 0


def test_contaminated_rows_with_null_and_shared_ids(spark, make):
    item = " ".join(f"i{i}" for i in range(20))
    halves = item.split()[:10], item.split()[10:]
    filler = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    texts = [(None, f"a {item} b"), (None, filler("n", 22)), (1, f"c {item} d"), (1, filler("o", 22)), (2, " ".join([*halves[0], filler("p", 10)])), (2, " ".join([filler("q", 10), *halves[1]])), (3, filler("r", 22)), (None, None)]
    texts += [texts[0]] * 4200  # with 16 shingles a window, more than 65,535 in all
    docs = spark.createDataFrame([(d, t, "en", "a", None) for d, t in texts], make([]).schema)
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((tuple(r) for r in decontamination.contaminated(docs, benchmark).select("doc_id", "item_id", "similarity", "start_word").collect()), key=str)
    assert got == [(1, 7, 1.0, 1), (None, 7, 1.0, 1)]
    kept = decontamination.without_contaminated(docs, benchmark)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(texts[i] for i in (1, 3, 4, 5, 6, 7))


def test_shards_are_contiguous_and_balanced(spark, sf):
    docs = queries.documents(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sorted(queries.op6_shard_bytes(spark, sf).collect(), key=lambda r: r["doc_id"])
    sizes = [len((texts[d] or "").encode()) + 1 for d in sorted(texts)]
    assert [(r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in rows] == [(d, n, zlib.crc32((texts[d] or "").encode()), "bytes") for d, n in zip(sorted(texts), sizes, strict=True)]
    start, total, slots = 0, sum(sizes), Counter()
    for r in rows:
        assert r["shard"] == min(15, (2 * start + r["size"]) * 16 // (2 * total)) and r["slot"] == slots[r["shard"]] and r["grown_shard"] is None
        slots[r["shard"]] += 1
        start += r["size"]


def test_shards_of_odd_rows(odd):
    rows = sharding.shard_by_bytes(odd, 4).collect()
    assert len(rows) == odd.count() and Counter((r["shard"], r["slot"]) for r in rows).most_common(1)[0][1] == 1


def slow_targets(sizes):
    """Targets by sharing what is cut off again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, capped = dict.fromkeys(sizes, Fraction(0)), Fraction(sum(sizes.values())), set()
    while True:
        live = [s for s in order if s not in capped]
        shares = {s: left * weights[s] / sum(weights[t] for t in live) for s in live}
        over = [s for s in live if shares[s] > 3 * sizes[s]]
        if not over:
            return target | shares
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            left -= 3 * sizes[s]
            capped.add(s)


def test_mix_meets_targets(make):
    rng = random.Random(8)
    sources = [rng.choice(["a", "b", "b", "b", "c", "d", None]) for _ in range(3000)] + ["tiny"] + ["hollow"]
    texts = [" ".join(["w"] * rng.choice([0, 1, 10, 400, 3000])) for _ in range(3000)] + ["w " * 50, None]
    docs = make(texts, sources)
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(texts)
    sizes, taken = Counter(), Counter()
    for r in rows:
        size = len(texts[r["doc_id"]].split()) if texts[r["doc_id"]] else 0
        assert r["size"] == size and 0 <= r["taken"] <= 3 * size
        sizes[sources[r["doc_id"]]] += size
        taken[sources[r["doc_id"]]] += r["taken"]
    targets = slow_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[sources[r["doc_id"]]] and math.isclose(r["target"], targets[sources[r["doc_id"]]], abs_tol=1e-6)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.02 * target + 2 * mixing.BLOCK_WORDS
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()), key=str)


def test_mix_of_odd_rows(odd):
    rows = mixing.taken(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.taken(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mix_copies_of_repeated_and_null_ids(spark, make):
    """Rows that share a doc_id, of one source or two, are no more than 3 copies each, and the words meet the targets."""
    rows = [(None if i < 40 else i // 4, f"{i} " + "w " * 299, "en", "ab"[i % 2] if i < 80 else "abbbbb"[i % 6], None) for i in range(1200)]
    rows += [(None, " ", "en", "a", None), (10, "", "en", "b", None)]
    docs = spark.createDataFrame(rows, make([]).schema)
    copies = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.mixed_documents(docs).collect())
    assert max(copies.values()) <= 3 and all(t.strip() for _, _, t in copies)
    words = Counter()
    for (_, source, _), n in copies.items():
        words[source] += 300 * n
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    for source, target in slow_targets(sizes).items():
        assert abs(words[source] - target) <= 0.1 * target


def test_mix_shards_are_draws_and_blocks_whole(spark, make):
    """Every slot of every shard is one block of its source, each pass takes each block once at most, and the counts of
    the shards scatter as draws do: around their expectation, neither all alike nor far off."""
    rng = random.Random(5)
    sources = [rng.choice("aabbbbbbc") for _ in range(2500)]
    docs = make([f"{i} " + "w " * rng.choice([30, 400, 2000]) for i in range(2500)], sources)
    sized = mixing.sizes(docs)
    targets = mixing.source_targets(sized)
    slots = [tuple(r) for r in mixing.draw_slots(targets, 3, shard_slots=512).select("source", "shard", "slot", "pass", "block").collect()]
    assert len({(h, t) for _, h, t, _, _ in slots}) == len(slots) == len({(s, p, b) for s, _, _, p, b in slots})
    assert {(h, t) for _, h, t, _, _ in slots} == {(i // 512, i % 512) for i in range(len(slots))}
    share = Counter(s for s, *_ in slots)
    shards = [Counter(s for s, h, *_ in slots if h == i) for i in range(len(slots) // 512)]
    for source, n in share.items():
        p = n / len(slots)
        spread = [(c[source] - 512 * p) / math.sqrt(512 * p * (1 - p)) for c in shards]
        assert 0.3 < sum(x * x for x in spread) / len(spread) < 2.5 and max(map(abs, spread)) < 5
    mixed = [tuple(r) for r in mixing.mix(docs, 3)[2].select("source", "block", "pass", "row", "from_word", "n_words").collect()]
    filled = Counter()
    for source, block, number, *_, n in mixed:
        filled[source, block, number] += n
    sizes = {r["source"]: r["source_size"] for r in targets.collect()}
    assert all(n == min(mixing.BLOCK_WORDS, sizes[s] - b * mixing.BLOCK_WORDS) for (s, b, _), n in filled.items())


def test_mix_of_repeated_ids_keeps_each_row_within_three_times(spark, make):
    rows = [(1, "w " * 400, "en", "a", None)] * 3 + [(1, "x " * 100, "en", "a", None), (2, "w " * 400, "en", "b", None)] + [(i, "z " * 400, "en", "b", None) for i in range(3, 60)]
    docs = spark.createDataFrame(rows, make([]).schema)
    taken = mixing.taken(docs).collect()
    assert len(taken) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in taken)
    assert max(Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect()).values()) <= 9


def test_mix_of_clashing_names(spark, make):
    names = ["_copies", "_copy", "whole", "key", "share", "row", "_row", "text_hash", "of"]
    docs = make(["w " * 500, "v " * 500], ["a", "b"])
    docs = docs.selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(names)])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() >= 1 and mixing.taken(docs).count() == 2


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        image = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
        assert sorted(r["p"] for r in image.collect()) == list(range(n))


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_base_counts_equal_brute_force(spark, sf, odd):
    for docs in (queries.documents(spark, sf), odd):
        texts = Counter((r["doc_id"], *slow_counts(r["text"])) for r in docs.select("doc_id", "text").collect())
        rows = weak_rules.judge(docs).collect()
        assert Counter((r["doc_id"], *(r[c] for c in weak_rules.COUNTS[:5])) for r in rows) == texts
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"])
            assert r["base_failed"] or r["kept"] == (r["posterior"] >= 0.5)


@pytest.mark.parametrize("operator", [jaccard_join.components, suffix_index.remove_repeats, sharding.shard_by_bytes, weak_rules.judge, mixing.mixed_documents])
def test_empty_tables_give_no_rows(make, operator):
    assert operator(make([])).count() == 0
