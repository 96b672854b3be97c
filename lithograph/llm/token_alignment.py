"""Alignment of two tokenizers' tokens over one text, and how firmly each link holds in the corpus (operator 13).

Both tokenizers cut the same bytes. The alignment is a transducer over their tokens: at any time one side leads by some
bytes that the other hasn't matched yet, the *residual*, always a suffix of the leader's last token. The next token is taken
from the side that lags; it is linked with the leader's last token, and either leaves a shorter residual, or takes the lead
with what sticks out, or leaves nothing, which closes a group. So each token but a group's first makes one link, and the
links are all pairs of tokens whose bytes overlap. The step hangs on the residual and the next token alone and is memoised
by them.

Most of a corpus is words seen before. Where a tokenizer's own rules say that no token and no merge crosses the place
before a run of spaces that follows another character (``cuts_at_spaces``: read from the tokenizer's settings and its whole
vocabulary, never from samples), texts are encoded and aligned segment by segment, and a segment that was met before is
looked up. Otherwise whole texts are segments. Both ends of a segment are ends of tokens of both sides, so groups never
cross segments.

Counts of links are corpus-wide. A task keeps its documents' links packed: a *pack* of documents has one table of the pairs
of ids that occur in it, and each document the numbers and times of its pairs. The pairs' times are summed over the corpus
by Spark, joined back per pack, and each pack is told what its own pairs have. No task gets all pairs, and a frequent pair is
one row per pack.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Where a segment begins: at spaces behind another character and before one. (Unicode white space is neither, nor is the
#: sign that pieces write for a space.)
SEGMENT = re.compile(r"(?<=[^\s▁])(?= +[^\s▁])")
SPACE_PIECE, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: Links, and bytes of text, of a pack of documents at most (but for a single document that has more).
PACK_LINKS, PACK_BYTES = 2_000_000, 12_000_000
#: Characters of the longest segment that is kept for later, and segments of a generation, of which a worker keeps two.
LONGEST_KEPT, GENERATION = 48, 200_000
A, B = 0, 1
PAIR = np.dtype([("pair", "<u4"), ("times", "<u4")])


# -- the two tokenizers -------------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; texts are led by a space, special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes = {i: t.encode() if t in added else bytes([letters[c] for c in t]) for t, i in known.items()}
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        before = settings.get("pre_tokenizer") or {}
        # the regular expression of byte-level tokenizers ends a part ahead of any run of white space behind other characters
        plain = settings.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.cuts_at_spaces = bool(plain) and settings["model"]["type"] == "BPE" and not settings["model"].get("dropout")

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the public protocol-buffer encoding."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A SentencePiece model, which leads texts by a space of its own."""

    #: Fields of the model file: the normaliser's settings; in them its map, whether it adds a space, whether it drops some.
    NORMALIZER, CHARACTER_MAP, ADD_SPACE, DROP_SPACES = 3, 2, 3, 4
    #: In a piece's record: its kind, and the kind of pieces that users define, which are cut out first.
    PIECE, KIND, USER_DEFINED = 1, 3, 4

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = {i: bytes.fromhex(m[1]) if self.model.is_byte(i) and (m := BYTE_PIECE.fullmatch(n)) else n.replace(SPACE_PIECE, " ").encode() for i, n in enumerate(names)}
        fields = list(message_fields(self.model.serialized_model_proto()))
        settings = dict(message_fields(next((v for k, v in fields if k == self.NORMALIZER), b"")))
        own = any(dict(message_fields(v)).get(self.KIND) == self.USER_DEFINED for k, v in fields if k == self.PIECE)
        faithful = not settings.get(self.CHARACTER_MAP) and settings.get(self.ADD_SPACE, 1) == 1 and settings.get(self.DROP_SPACES, 1) == 0
        # merges can't join what no piece holds: a space behind another character
        self.cuts_at_spaces = faithful and not own and not any(re.search(f"[^{SPACE_PIECE}]{SPACE_PIECE}", n) for n in names)

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Segments are led by a space, which the model adds itself."""
        return self.model.encode([s[1:] for s in segments], num_threads=1)


# -- the transducer -----------------------------------------------------------------------------------------------------


class Transducer:
    """Aligns the ids of two sides that cut the same bytes; steps are memoised by (side that leads, residual, next id)."""

    def __init__(self, bytes_a: dict[int, bytes], bytes_b: dict[int, bytes]):
        self.bytes, self.steps = (bytes_a, bytes_b), {}

    def step(self, leader: int, residual: bytes, token: int) -> tuple[int, bytes]:
        """The state after ``token`` of the side that lags: (side that leads, residual), without a residual if a group closes."""
        new = self.bytes[1 - leader][token]
        if residual.startswith(new):
            return leader, residual[len(new) :]
        if not new.startswith(residual):
            raise ValueError("the sides cut different bytes")
        return 1 - leader, new[len(residual) :]

    def align(self, ids: tuple[list[int], list[int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(links: pairs of ids; groups: places up to which each side's ids belong to it)."""
        (ids_a, ids_b), links, groups, steps = ids, [], [], self.steps
        a = b = 0
        while a < len(ids_a):
            leader, last = A, ids_a[a]
            a += 1
            residual = self.bytes[A][last]
            while residual:
                if leader == A:
                    token = ids_b[b]
                    b += 1
                    links.append((last, token))
                else:
                    token = ids_a[a]
                    a += 1
                    links.append((token, last))
                key = (leader, residual, token)
                if (after := steps.get(key)) is None:
                    if len(steps) > 300_000:
                        steps.clear()
                    after = steps[key] = self.step(*key)
                if after[0] != leader:
                    last = token
                leader, residual = after
            groups.append((a, b))
        return links, groups


def shown_groups(ids: tuple[list[int], list[int]], groups: list[tuple[int, int]], names: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of both sides (``names``: all of them), group by group."""
    side_a, side_b = list(map(names.__getitem__, ids[A])), list(map(names.__getitem__, ids[B]))
    if len(groups) == 1:
        return ",".join(side_a) + "|" + ",".join(side_b)
    out, a, b = [], 0, 0
    for next_a, next_b in groups:
        if next_a - a == next_b - b == 1:
            out.append(f"{side_a[a]}|{side_b[b]}")
        else:
            out.append(",".join(side_a[a:next_a]) + "|" + ",".join(side_b[b:next_b]))
        a, b = next_a, next_b
    return ";".join(out)


class Segments:
    """What alignment gives for segments (each led by a space): None if a side's bytes aren't the segment's; else numbers
    of tokens of both sides and of groups, the links' pairs (a << 32 | b) as bytes, and the groups as text."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b, self.transducer = a, b, Transducer(a.bytes, b.bytes)
        self.bytes_a, self.bytes_b = a.bytes.__getitem__, b.bytes.__getitem__
        self.names = [str(i) for i in range(max([*a.bytes, *b.bytes]) + 1)]
        self.young, self.old = {}, {}
        self.cut = a.cuts_at_spaces and b.cuts_at_spaces

    def of(self, text: str) -> list[str]:
        whole = " " + text
        return SEGMENT.split(whole) if self.cut else [whole]

    def learn(self, segments: set[str]) -> dict[str, tuple | None]:
        """Results of ``segments``. Those met before are looked up; a full generation takes the place of the one before it,
        in which segments that still occur have been renewed."""
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        found, fresh, young, old = {}, [], self.young, self.old
        for segment in segments:
            if segment in young:
                found[segment] = young[segment]
            elif segment in old:
                found[segment] = young[segment] = old[segment]
            else:
                fresh.append(segment)
        for some in (fresh[i : i + 4096] for i in range(0, len(fresh), 4096)):
            for segment, ids_a, ids_b in zip(some, self.a.encode(some), self.b.encode(some), strict=True):
                found[segment] = told = self._aligned(segment, (ids_a, ids_b))
                if len(segment) <= LONGEST_KEPT and len(young) < 2 * GENERATION:
                    young[segment] = told
        return found

    def _aligned(self, segment: str, ids: tuple[list[int], list[int]]) -> tuple | None:
        data = segment.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a, ids[A])) != data or b"".join(map(self.bytes_b, ids[B])) != data:
            return None
        if len(ids[A]) == len(ids[B]) == 1:
            return 1, 1, 1, array("q", [ids[A][0] << 32 | ids[B][0]]).tobytes(), f"{ids[A][0]}|{ids[B][0]}"
        links, groups = self.transducer.align(ids)
        return len(ids[A]), len(ids[B]), len(groups), array("q", [x << 32 | y for x, y in links]).tobytes(), shown_groups(ids, groups, self.names)


def kept_segments(path_a: str, path_b: str) -> Segments:
    """The tokenizers and what was learnt with them, which a worker process keeps for all its tasks.

    Functions that are sent to executors bring globals of their own with each task, so these hang on the process.
    """
    import builtins

    kept = builtins.__dict__.setdefault("_token_alignment", {})
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Segments(ByteLevel(path_a), Pieces(path_b))
    return kept[path_a, path_b]


# -- packs --------------------------------------------------------------------------------------------------------------


def aligned_packs(docs: DataFrame, path_a: str, path_b: str, pack_links: int = PACK_LINKS) -> DataFrame:
    """Rows of packs: pack, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (PAIR: numbers in the pack's table and
    times) of each document; and one row per pack (``pairs`` not null) with its table of pairs and their times."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, number = kept_segments(path_a, path_b), TaskContext.get().partitionId() << 32
        rows, held, n_links = [], [], 0

        def flushed() -> pa.RecordBatch:
            nonlocal number, n_links
            pairs, at = np.unique(np.concatenate(held or [np.zeros(0, "<i8")]), return_inverse=True)
            begin, links = 0, []
            for some in held:
                mine, times = np.unique(at[begin : begin + len(some)], return_counts=True)
                begin += len(some)
                packed = np.zeros(len(mine), PAIR)
                packed["pair"], packed["times"] = mine, times
                links.append(packed.tobytes())
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(6)]
            times = np.bincount(at, minlength=len(pairs))
            out = [pa.array(c + [None], kind) for c, kind in zip(columns, [id_type, *[pa.int64()] * 4, pa.string()], strict=True)]
            table = [pa.array([None] * len(rows) + [x.astype("<i8").tobytes()], pa.binary()) for x in (pairs, times)]
            found = pa.RecordBatch.from_arrays([pa.array([number] * (len(rows) + 1), pa.int64()), *out, pa.array([*links, None], pa.binary()), *table], names)
            number, n_links = number + 1, 0
            rows.clear(), held.clear()
            return found

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in slices(texts):
                cut = [segments.of(t) if t else [] for t in texts[first:last]]
                met = segments.learn({s for c in cut for s in c})
                for doc, parts in zip(ids[first:last], cut, strict=True):
                    told = [met[p] for p in parts]
                    if not told or None in told:
                        rows.append((doc, 0, 0, 0, 0, ""))
                        held.append(np.zeros(0, "<i8"))
                        continue
                    a, b, groups, pairs, shown = zip(*told, strict=True)
                    n = sum(a) + sum(b) - sum(groups)
                    rows.append((doc, sum(a), sum(b), sum(groups), n, hashlib.sha256(";".join(shown).encode()).hexdigest()))
                    held.append(np.frombuffer(b"".join(pairs), "<i8"))
                    n_links += n
                    if n_links >= pack_links or len(rows) >= 16_384:
                        yield flushed()
        if rows:
            yield flushed()

    names = ["pack", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "times"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pack, f"pack long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs binary, times binary")


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts of PACK_BYTES characters together at most, or one text that has more."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text or "") > PACK_BYTES // 4:
            yield first, i
            first, size = i, 0
        size += len(text or "")
    if first < len(texts):
        yield first, len(texts)


def pack_pairs(packs: DataFrame) -> DataFrame:
    """pack, number, pair, times of all packs' tables."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, pairs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(pairs) // 8, 65_536):
                    pair, time = (np.frombuffer(x, "<i8")[at : at + 65_536] for x in (pairs, times))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), pack)), pa.array(np.arange(at, at + len(pair), dtype=np.int32)), pa.array(pair), pa.array(time)], ["pack", "number", "pair", "times"])

    return packs.where("pairs is not null").select("pack", "pairs", "times").mapInArrow(opened, "pack long, number int, pair long, times long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """pair, count, best (whether no pair with the same B id has a larger count): corpus-wide."""
    counts = written(pairs.groupBy("pair").agg(F.sum("times").alias("count")), "counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    # a row per id of B's vocabulary, whose size bounds what is broadcast
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, pack_links: int = PACK_LINKS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, as the module says.

    ``path_a``: a byte-level tokenizer (its texts are led by a space); ``path_b``: a SentencePiece model that leads texts by
    a space itself. Texts that are null, empty, or that a side can't give back byte by byte have no tokens: zeros and an
    empty groups_sha256. n_best: links whose pair's count is the highest of its B id; count_sum: the sum of links' counts.
    Repeated rows count again and are alike; an empty table gives no rows; other columns are ignored.
    """
    packs = written(aligned_packs(docs, path_a, path_b, pack_links), "packs")
    pairs = written(pack_pairs(packs), "pairs")
    known = pairs.select("pack", "number", "pair").hint("merge").join(link_counts(pairs).hint("merge"), "pair").select("pack", "number", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def told(documents: pa.Table, known: pa.Table) -> pa.Table:
        number, size = np.array(known.column("number")), known.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[number], best[number] = np.array(known.column("count")), np.array(known.column("best"))
        n_best, count_sum = [], []
        for links in documents.column("links").to_pylist():
            rows = np.frombuffer(links, PAIR)
            n_best.append(int((best[rows["pair"]] * rows["times"]).sum()))
            count_sum.append(int((count[rows["pair"]] * rows["times"]).sum()))
        kept = [documents.column(n) for n in names[:5]]
        return pa.table([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), documents.column("groups_sha256")], names)

    documents = packs.where("pairs is null").drop("pairs", "times")
    return documents.groupBy("pack").cogroup(known.groupBy("pack")).applyInArrow(told, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
