"""Token ids in seekable binary files (operator 1).

A file holds, in this order:

* data frames: independent zstandard frames with content size and content checksum. A frame's content is: number of
  documents (u32), doc_ids (i64 each), 1 for each null doc_id (u8 each), numbers of tokens (u64 each), then all ids
  (u16 or u32, little-endian).
* the directory, in a skippable frame: bytes per id (u32), then for each data frame its first and last doc_id (i64),
  documents (u64) and tokens (u64).
* the seek table of the public zstandard seekable format: per frame its compressed size, its size and the low 32 bits of
  the content's XXH64, then number of frames, flags and the magic number.

A reader opens a file at its end, finds the frames of the documents it wants and decompresses these alone.
"""

from __future__ import annotations

import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions

#: Fixed values of the zstandard frame formats.
SKIPPABLE_MAGIC, SEEK_TABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER, PLACE = "<III", "<IBI", "<qqQQ"
ENTRY_BYTES, FOOTER_BYTES, PLACE_BYTES = 12, 9, 32
FRAME_BYTES = 1 << 20
MEMO_WORDS = 700_000


class WordMemo(dict):
    """Bytes of the ids of white-space separated words, encoded when they are first asked for.

    For tokenizers that lower-case, split letters from marks and never cross ASCII white space, a text's ids are those
    of its words one after another, and a word's ids are those of its core and of the marks after it. Cores of small
    Latin letters alone are a single piece that no normalizing changes, so they go to the library's model at once; all
    others are encoded by the whole tokenizer. When the memo is half full, its words become the older half; those that
    are asked for again come back, the others are forgotten at the next turn. Very long words aren't kept.

    Whether a tokenizer is of that kind is tried out on PROBES and on the first texts of each task; where it isn't, the
    library encodes whole texts.
    """

    MARKS = b".,!?#*$%&|;:"
    #: Bytes of a-z and of the small letters of Latin-1; the characters that stand for all bytes in byte-level vocabularies.
    LETTERS = bytes([*range(0x61, 0x7B), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
    BYTE_LEVEL = bytes(range(256)).decode("latin-1").translate({b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])})
    #: Words, marks, digits, accents and white space next to each other; the texts of a task tried out besides, and their length.
    PROBES = ("a b", " a  b\n\tc ", "don't stop. (No, 3.14!) 12 345", "\u00e9t\u00e9 caf\u00e9s \u4e2d\u6587 x\u00a0y", "A-b_c/d 'quoted' \"x\" e@f.gh ~ #1 100%", "a\r\nb", "1 2 3")
    LETTER_PROBES = ("a", "abcdefghijklmnopqrstuvwxyz", "the", "information", *map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]), "caf\u00e9s", "stra\u00dfen\u00fcber")
    TRIED, TRIED_CHARACTERS = 8, 4000
    KEPT_BYTES = 256

    def __init__(self, tokenizer_path: str, id_type: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.id_type, self.before = Tokenizer.from_file(tokenizer_path), id_type, {}
        self.model, width = self.tokenizer.model, np.dtype(id_type).itemsize
        self.bytes_of = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts = self.ids(["Ab.", "ab", "."])
        self.parts = self.parts[0] == self.parts[1] + self.parts[2]
        # the tokens that the library looks for before all else hold "<|", so that they can't hide in other words
        self.by_words = all("<|" in t.content and len(t.content.split()) == 1 for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_letters = self.by_words and self.parts and [self.of_letters(word.encode()) for word in self.LETTER_PROBES] == self.whole(list(self.LETTER_PROBES))
        self.try_out(list(self.PROBES))

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def of_letters(self, core: bytes) -> bytes:
        piece = core.decode() if core.isascii() else charmap_decode(core, "strict", self.BYTE_LEVEL)[0]
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(piece)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            core = word.rstrip(self.MARKS) if self.parts else word
            letters = self.by_letters and not core.translate(None, self.LETTERS)
            # marks are split off only after letters and digits, where no token can reach over
            if core and len(core) < len(word) and (letters or core[-1:].isalnum()) and b"<|" not in word:
                ids = self[core] + self[word[len(core) :]]
            elif letters and core:
                ids = self.of_letters(core)
            elif self.by_letters and not (small := word.decode().lower().encode()).translate(None, self.LETTERS):
                ids = self.of_letters(small)
            else:
                ids = self.whole([word.decode()])[0]
        if len(word) > self.KEPT_BYTES:
            return ids
        if len(self) >= MEMO_WORDS // 2:
            self.before = self.copy()
            self.clear()
        self[word] = ids
        return ids

    def try_out(self, texts: list[str]) -> None:
        self.by_words = self.by_words and self.encode(texts) == self.whole(texts)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.id_type).tobytes() for ids in self.ids(texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.whole(texts)
        # bytes: lower() and split() touch ASCII alone; special tokens are looked for before the library lower-cases
        data = [text.encode() for text in texts]
        return [b"".join(map(self.__getitem__, (d.lower() if self.parts and b"<|" not in d else d).split())) for d in data]


def kept_memo(tokenizer_path: str, id_type: str) -> WordMemo:
    """The memo of this worker process, which lives on between its tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_lithograph_memos", {})
    if (tokenizer_path, id_type) not in kept:
        kept[tokenizer_path, id_type] = WordMemo(tokenizer_path, id_type)
    return kept[tokenizer_path, id_type]


def frame(documents: list[tuple[int | None, bytes]], width: int) -> bytes:
    ids = np.array([d or 0 for d, _ in documents], "<i8")
    nulls = np.array([d is None for d, _ in documents], "u1")
    counts = np.array([len(b) // width for _, b in documents], "<u8")
    return b"".join([struct.pack("<I", len(documents)), ids.tobytes(), nulls.tobytes(), counts.tobytes(), *(b for _, b in documents)])


def unframe(content: bytes, width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    n = struct.unpack_from("<I", content)[0]
    ids, nulls, counts = np.frombuffer(content, "<i8", n, 4), np.frombuffer(content, "u1", n, 4 + 8 * n), np.frombuffer(content, "<u8", n, 4 + 9 * n)
    at = 4 + 17 * n
    for doc, null, count in zip(ids.tolist(), nulls.tolist(), counts.tolist(), strict=True):
        yield None if null else doc, np.frombuffer(content, f"<u{width}", count, at)
        at += count * width


class TokenFile:
    """Write with ``add`` and ``close``; one frame's documents are in memory at a time."""

    def __init__(self, stream, width: int, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.stream, self.width, self.frame_bytes = stream, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.waiting, self.waiting_bytes, self.entries, self.places, self.bytes = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting.append((doc_id, ids))
        self.waiting_bytes += len(ids) + 17
        if self.waiting_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.waiting:
            return
        content = frame(self.waiting, self.width)
        packed = self.zstd.compress(content)
        if max(len(content), len(packed)) >= 1 << 32:
            raise ValueError(f"document {self.waiting[-1][0]} doesn't fit a frame of 4 GiB")
        self.entries.append(struct.pack(ENTRY, len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        known = [d for d, _ in self.waiting if d is not None] or [0]
        self.places.append(struct.pack(PLACE, min(known), max(known), len(self.waiting), sum(len(b) for _, b in self.waiting) // self.width))
        self.stream.write(packed)
        self.bytes += len(packed)
        self.waiting, self.waiting_bytes = [], 0

    def close(self) -> int:
        self.flush()
        places = struct.pack("<I", self.width) + b"".join(self.places)
        table = b"".join(self.entries) + struct.pack(FOOTER, len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        for magic, content in ((SKIPPABLE_MAGIC, places), (SEEK_TABLE_MAGIC, table)):
            self.stream.write(struct.pack("<II", magic, len(content)) + content)
            self.bytes += 8 + len(content)
        return self.bytes


class TokenReader:
    """Frames and documents of a token file; reads and decompresses only what is asked for, and checks it."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.size()
        n, flags, magic = struct.unpack(FOOTER, self.at(end - FOOTER_BYTES, FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token file: no seek table at its end")
        table = self.at(end - FOOTER_BYTES - n * ENTRY_BYTES, n * ENTRY_BYTES)
        self.entries = [struct.unpack_from(ENTRY, table, i * ENTRY_BYTES) for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype="i8")]).tolist()
        places = self.at(self.offsets[-1] + 8, 4 + n * PLACE_BYTES)
        self.width = struct.unpack_from("<I", places)[0]
        self.places = [struct.unpack_from(PLACE, places, 4 + i * PLACE_BYTES) for i in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([p[3] for p in self.places], dtype="i8")]).tolist()

    def at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        import xxhash

        packed, size, checksum = self.entries[i]
        content = self.zstd.decompress(self.at(self.offsets[i], packed))
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return unframe(content, self.width)

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        wanted = sorted(set(wanted))
        for i, (first, last, _, _) in enumerate(self.places):
            if any(first <= d <= last for d in wanted):
                yield from ((d, ids) for d, ids in self.frame(i) if d in wanted)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, n_files: int | None = None) -> DataFrame:
    """Encode every text and write token files in ascending doc_id order below ``folder``; return their manifest.

    The manifest (file, path, frames, documents, tokens, bytes; one row per file) is written to ``folder``/manifest. A
    retried task writes its file anew under another name and puts it in the first one's place. Null texts count as
    empty and have the end id alone; null doc_ids come first; rows with the same doc_id stand in order of their texts;
    an empty table gives no files; other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow import fs

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        memo, end = kept_memo(tokenizer_path, f"<u{width}"), end_id.to_bytes(width, "little")
        store, root = fs.FileSystem.from_uri(folder)
        path, part = f"{root}/tokens-{number:06d}.zst", f"{root}/.tokens-{number:06d}-{attempt}"
        out, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                if out is None:
                    memo.try_out([t for t in texts[: memo.TRIED] if len(t) <= memo.TRIED_CHARACTERS])
                for doc, ids in zip(rows.column(0).to_pylist(), memo.encode(texts), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        stream = store.open_output_stream(part)
                        out = TokenFile(stream, width)
                    out.add(doc, ids + end)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // width + 1
        if out is not None:
            size = out.close()
            stream.close()
            store.move(part, path)
            yield pa.RecordBatch.from_pylist([{"file": number, "path": path, "frames": len(out.entries), "documents": n_docs, "tokens": n_tokens, "bytes": size}])

    dealt = docs.select("doc_id", "text").repartitionByRange(n_files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, "file long, path string, frames long, documents long, tokens long, bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None, frames_a_task: int = 8) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (only if some are ``wanted``), by frame.

    With ``wanted`` doc_ids, only the frames that may hold them are read.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("path", "frames", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    work = files.select("path", "start", "frames", F.explode(F.expr(f"sequence(0L, frames - 1, {frames_a_task}L)")).alias("first")).repartition(partitions(spark), "path", "first")
    asked = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    reader = TokenReader(source)
                    for i in range(row["first"], min(row["first"] + frames_a_task, row["frames"])):
                        if asked is not None and not any(reader.places[i][0] <= d <= reader.places[i][1] for d in asked):
                            continue
                        start, out = row["start"] + reader.starts[i], []
                        for doc, ids in reader.frame(i):
                            if asked is None or doc in asked:
                                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + (() if asked is None else (ids.tolist(),)))
                            start += len(ids)
                        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                        columns = list(zip(*out, strict=True)) or [()] * (4 + (asked is not None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return work.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if asked is None else ", ids array<long>"))

