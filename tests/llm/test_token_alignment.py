import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from lithograph.llm import queries, token_alignment
from lithograph.llm.token_alignment import A, B, ByteLevel, Pieces, Segments, Transducer
from tokenizers import Tokenizer

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def whole_ids(text):
    """Both sides' ids of the whole text, and their tokens' bytes, straight from the libraries."""
    a = Tokenizer.from_file(PATHS[0]) if not hasattr(whole_ids, "a") else whole_ids.a
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1]) if not hasattr(whole_ids, "b") else whole_ids.b
    whole_ids.a, whole_ids.b = a, b
    a.encode_special_tokens = True
    names = a.encode(" " + text, add_special_tokens=False)
    letters = token_alignment.byte_letters()
    ids = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids]
    bytes_b = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
    return (names.ids, ids), ([bytes([letters[c] for c in t]) for t in names.tokens], bytes_b)


def by_offsets(text):
    """(n_a, n_b, groups as text, links) by byte offsets: no transducer."""
    if not text:
        return 0, 0, "", []
    ids, tokens = whole_ids(text)
    if any(b"".join(side) != (" " + text).encode() for side in tokens):
        return 0, 0, "", []
    spans = []
    for side in tokens:
        at, mine = 0, []
        for t in side:
            mine.append((at, at + len(t)))
            at += len(t)
        spans.append(mine)
    links, j = [], 0
    for i, (x, y) in enumerate(spans[A]):
        while j and spans[B][j - 1][1] > x:
            j -= 1
        while j < len(spans[B]) and spans[B][j][0] < y:
            if spans[B][j][1] > x:
                links.append((ids[A][i], ids[B][j]))
            j += 1
    ends = sorted({y for _, y in spans[A]} & {y for _, y in spans[B]})
    groups, a, b = [], 0, 0
    for end in ends:
        first = a, b
        while a < len(spans[A]) and spans[A][a][1] <= end:
            a += 1
        while b < len(spans[B]) and spans[B][b][1] <= end:
            b += 1
        groups.append(",".join(map(str, ids[A][first[0] : a])) + "|" + ",".join(map(str, ids[B][first[1] : b])))
    return len(ids[A]), len(ids[B]), ";".join(groups), links


def brute_force(rows):
    told = [(doc, by_offsets(text)) for doc, text in rows]
    counts = Counter(link for _, (*_, links) in told for link in links)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for doc, (n_a, n_b, groups, links) in told:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups.split(";")) if groups else 0, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def told(frame):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()), key=str)


ODD = [
    None, "", " ", "  ", "a", "word", " led by a space", "trailing  ", "two  spaces   three", "a\u00a0b \u00a0 c", "line\nline \n line\n\n  x", "tab\tx \t y", "x\u2028 y\u3000 z", "▁ ▁x", "x ▁y",
    "<|endoftext|> </s> <s>", "<0x41> <0x0A>", "don't it's we'll 'S", "12345 67 890", "❤️ 👩\u200d👩\u200d👧 ünïcödé", "日本語 の テキスト", "\x00\x01 \x1f x", "a" * 5000, "ab " * 3000, "é" * 300 + " " * 300 + "é", "\ufeffbom", "é ́x",
]


def test_alignment_of_odd_texts_equals_offsets(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "word"), (None, "no identity"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, pair int, pack int")
    assert told(token_alignment.align(docs, *PATHS)) == brute_force(rows)
    assert told(token_alignment.align(docs, *PATHS, pack_links=5)) == brute_force(rows)  # many packs
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_segments_give_what_whole_texts_give():
    random.seed(3)
    segments = Segments(ByteLevel(PATHS[0]), Pieces(PATHS[1]))
    assert segments.cut
    characters = [*"abc def  xyz.,'-\n\t12", "\u00a0", "\u2028", "é", "▁", "'s", " the", "  ", "\x1c", "\x85", "日"]
    for _ in range(1500):
        text = "".join(random.choices(characters, k=random.randint(1, 25)))
        parts = segments.of(text)
        assert "".join(parts) == " " + text
        ids, _ = whole_ids(text)
        cut = [list(x) for side in (segments.a, segments.b) for x in [sum(side.encode(parts), [])]]
        assert cut == [list(i) for i in ids], repr(text)


def test_the_transducer_tracks_who_leads():
    sides = {1: b"ab", 2: b"c", 3: b"d"}, {7: b"a", 8: b"bcd", 9: b"abc", 6: b""}
    machine = Transducer(*sides)
    assert machine.align(([1, 2, 3], [7, 8])) == ([(1, 7), (1, 8), (2, 8), (3, 8)], [(3, 2)])
    assert machine.align(([1, 2], [9])) == ([(1, 9), (2, 9)], [(2, 1)]) and machine.align(([], [])) == ([], [])
    assert machine.steps[A, b"ab", 7] == (A, b"b") and machine.steps[A, b"b", 8] == (B, b"cd") and machine.steps[B, b"d", 3] == (B, b"")
    with pytest.raises(ValueError, match="different bytes"):
        machine.align(([3], [7]))


def test_settings_decide_about_segments(tmp_path):
    assert ByteLevel(PATHS[0]).cuts_at_spaces and Pieces(PATHS[1]).cuts_at_spaces
    text = open(PATHS[0], encoding="utf-8").read()
    other = tmp_path / "other.json"
    other.write_text(text.replace('"use_regex":true', '"use_regex":false', 1).replace('"use_regex": true', '"use_regex": false', 1), encoding="utf-8")
    assert not ByteLevel(str(other)).cuts_at_spaces


def test_alignment_of_the_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    assert told(queries.op13_token_alignment(spark, sf)) == brute_force(rows)


def test_alignment_of_odd_rows(spark, odd):
    assert told(token_alignment.align(odd, *PATHS)) == brute_force([(r.doc_id, r.text) for r in odd.collect()])
