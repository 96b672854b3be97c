import random
import zlib
from collections import Counter

import numpy as np
import pytest
from lithograph.llm import queries, spelling_variants
from lithograph.llm.spelling_variants import Ordered, WaveletTree, near_pairs

LETTERS = {*map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))}


def runs_of(text):
    run = []
    for c in text + " ":
        if c in LETTERS:
            run.append(c)
        elif run:
            yield "".join(run)
            run = []


def brute_force(rows):
    """word: (form, root, n, n_near, form_n) by the definition; rows: (doc_id, text)."""
    counts = Counter()
    for doc, text in rows:
        for run in runs_of(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def edits(w):
        every = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        return every - {w}

    alphabet = {c for w in n for c in w}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in edits(w) if v in n]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def told(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 100])
def test_the_tree_reports_what_lies_in_a_rectangle(n):
    random = np.random.default_rng(n)
    y = random.permutation(n)
    x1, x2, y1, y2 = (random.integers(0, n + 1, 300) for _ in range(4))
    query, found = WaveletTree(y).report(x1, x2, y1, y2)
    assert sorted(zip(query.tolist(), found.tolist(), strict=True)) == sorted((q, int(y[x])) for q in range(300) for x in range(x1[q], x2[q]) if y1[q] <= y[x] < y2[q])


@pytest.mark.parametrize("shorter", [0, 1])
def test_near_pairs_are_all_single_edits(shorter):
    random.seed(shorter)
    words = lambda k, n: sorted({"".join(random.choices("abÿ", k=k)) for _ in range(n)})
    asked = words(6, 300)
    among = asked if not shorter else words(5, 150)
    rows = lambda texts: np.array([list(w.encode("latin-1")) for w in texts], np.uint8)
    tree = Ordered(rows(among))
    text = lambda row: bytes(row).decode("latin-1")
    ask, other = near_pairs(rows(asked), tree, range(1, 6))
    got = [(asked[i], text(tree.words[j])) for i, j in zip(ask, other, strict=True)]
    differ = lambda w, v: [i for i in range(6) if w[i] != v[i]]
    if shorter:
        wanted = [(w, v) for w in asked for v in among if v in {w[:i] + w[i + 1 :] for i in range(1, 6) if w[i] != w[i - 1]}]
    else:
        wanted = [(w, v) for w in asked for v in among if len(differ(w, v)) == 1 and differ(w, v)[0] > 0]
    assert sorted(got) == sorted(wanted)


def corpus():
    random.seed(5)
    base = ["".join(random.choices("abcé", k=random.randint(7, 9))) for _ in range(40)]
    words = base * 30
    for w in base * 3:
        i = random.randrange(len(w))
        words += [random.choice([w[:i] + w[i + 1 :], w[:i] + "d" + w[i:], w[:i] + "x" + w[i + 1 :], w.upper()])] * random.randint(1, 3)
    random.shuffle(words)
    return [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20)] + [(7, "repeated Wordword wordword"), (7, "repeated Wordword wordword")]


@pytest.mark.parametrize(("key_words", "block_words"), [(20_000, 50_000), (3, 10)])
def test_variants_equal_brute_force(spark, make, key_words, block_words):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling_variants.variants(docs, key_words, block_words).collect()
    assert len(got) == len(told(got)) and told(got) == brute_force(rows)
    assert any(r.form and r.root != r.form for r in got) or any(r.form for r in got)


def test_chains_ties_and_both_ends(spark):
    texts = ["abcdefg " * 1000, "abcdefgh " * 50, "abcdefghi " * 3, "zbcdefghi " * 3, "aaaaaaaa " * 40, "aaaaaaa " * 40, "aaaaaaaaa aaaaaaaaa", "xaaaaaaa xaaaaaaa", "ÀÀÀÀÀÀÀ àààààààà ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ"]
    rows = list(enumerate(texts))
    got = told(spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_force(rows)
    assert got["abcdefghi"][:2] == ("abcdefgh", "abcdefg") and got["xaaaaaaa"][0] == "aaaaaaa"  # of equal counts the smaller word


def test_very_long_words_and_odd_rows(spark, odd):
    long = "ab" * 20_000
    whole = lambda i, w: zlib.crc32(f"{i}:{w}".encode()) % 31 != 0
    at = next(i for i in range(99) if whole(i, long) and whole(i, long[:-1]))  # a document that leaves both as they are
    rows = [(at, f"{long} {long} {long[:-1]} {long[:-1]}"), (None, None), (None, "nullword nullword"), (300, "")]
    got = told(spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {w: (None, w, 2, near, None) for w, near in ((long, 1), (long[:-1], 1), ("nullword", 0))}
    assert told(spelling_variants.variants(odd).collect()) == brute_force([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling_variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_of_the_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    assert told(queries.op12_spelling_variants(spark, sf).collect()) == brute_force(rows)
