"""Token ids in binary files: one zstandard frame per document and a trailing seek table.

File format: for each document one independent zstandard frame of its ids as little-endian
unsigned 32-bit integers; then a skippable frame with the documents' ids (count as 8 bytes,
8 bytes per id, one byte per id that is 1 where the id is null); then the seek table of the
zstandard seekable format, itself a skippable frame, with the compressed size, the original
size and the checksum (lower 32 bits of XXH64) of every frame. A reader takes the table from
the end of the file and decompresses the frames that it wants, checking each.

Documents are put in order by ranges of their id, so each task writes one file and files
follow each other. A file is written under a name of its own attempt and renamed, so a task
that runs again replaces its file by an equal one. Files go to any store that pyarrow
opens by its address, in a folder that all executors share.

Defined results: null text counts as empty and yields the end id alone; null ids come
first; rows that repeat an id follow each other, ordered by a hash of their text; an empty
table writes no file. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged, table, text_of

SKIPPABLE, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LEVEL = 3
#: Distinct units per generation of a worker's memory, and the longest unit it remembers.
CACHE_WORDS, CACHE_CHARS = 500_000, 64

# The pre-tokenizer's pattern, spelled out for texts of the first 256 characters.
_LETTER, _NUMBER, _BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+").findall
_LINES = re.compile(r"(?<=\S)\n(?=\S)").split


def _evenly_spaced(text: str) -> bool:
    """Whether all white space is single blanks and line feeds between other characters."""
    words = text.split()
    return len("".join(words)) + len(words) - 1 == len(text) and len(words) - 1 == text.count(" ") + text.count("\n")


# The character that byte-level BPE puts for each byte; printable ones stand for themselves.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {x: x for x in _SHOWN} | {x: 256 + k for k, x in enumerate(sorted(set(range(256)) - _SHOWN))}
#: Signs that a pre-token of signs consists of, if they follow a letter and end a unit.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Units(dict):
    """Ids by unit, learned where they are missing; what is used moves on when a new generation begins."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit) or self.learn(unit)
        if len(unit) <= CACHE_CHARS:
            self[unit] = ids
        return ids

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class BpeEncoder:
    """Whole-text encoding by the tokenizers library, which sees each distinct word once.

    Byte-level BPE never merges across pre-tokens, and a pre-token starts at every single blank
    or line feed between two other characters, and behind such a line feed. What stands
    between them is a unit, with the blank in front. A unit of letters, perhaps with signs at its
    end, is one pre-token, or two, and goes to the library's model as such; others go through the whole library.
    Stretches with other white space are cut by the pre-tokenizer's pattern if they hold only
    the first 256 characters; others, and texts with the strings of special tokens, go
    through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain, self.blank = _Units(self._ids), _Units(lambda unit: self._ids(unit, " "))
        self.signs = _Units(self.whole)
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, unit: str, before: str = "") -> bytes:
        word = unit.rstrip(_SIGNS)
        if not word.isalpha():
            return self.whole(before + unit)
        if word != unit:
            return (self.blank if before else self.plain)[word] + self.signs[unit[len(word) :]]
        return array("I", [t.id for t in self.model.tokenize((before + word).encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        first, after, out = self.plain.__getitem__, self.blank.__getitem__, []
        for t in texts:
            if not t:
                out.append(b"")
            elif any(s in t for s in self.special):
                out.append(self.whole(t))
            else:
                lines, even = (t.split("\n"), True) if _evenly_spaced(t) else (_LINES(t), False)
                ids = []
                for line in lines:
                    if even or _evenly_spaced(line) and "\n" not in line:
                        units = iter(line.split(" "))
                        ids.append(b"".join([first(next(units)), *map(after, units)]))
                    elif line.isascii() or max(line) < "\u0100":
                        ids.append(b"".join(map(first, _CUT(line))))
                    else:
                        ids.append(self.whole(line))
                out.append(self.line.join(ids))
        for held in (self.plain, self.blank, self.signs):
            held.age()
        return out


@lru_cache(maxsize=2)
def bpe_encoder(path: str) -> BpeEncoder:
    return BpeEncoder(path)


class TokenFileWriter:
    """Appends documents to an open binary stream; close() adds the seek table."""

    def __init__(self, stream):
        import xxhash
        import zstandard

        self.stream, self.frames, self.ids = stream, [], []
        self._pack, self._sum = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), xxhash.xxh64_intdigest

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self._pack.compress(ids)
        self.stream.write(frame)
        self.frames.append((len(frame), len(ids), self._sum(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        n = len(self.ids)
        body = struct.pack("<Q", n) + np.array([x or 0 for x in self.ids], "<i8").tobytes() + bytes(x is None for x in self.ids)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        rows = np.array(self.frames, "<u4").tobytes()
        foot = struct.pack("<IBI", n, 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(rows) + len(foot)) + rows + foot)
        self.stream.close()


class TokenFile:
    """Random access to a token file: doc_ids, sizes, and read(k) for the k-th document's ids."""

    def __init__(self, address: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(address)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{address} has no seek table")
        rows = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts, self.packed, self.sizes, self.sums = np.concatenate(([0], np.cumsum(rows[:, 0]))), rows[:, 0], rows[:, 1], rows[:, 2]
        at = int(self.starts[-1])
        head, length, count = struct.unpack("<IIQ", self.file.read_at(16, at))
        if head != SKIPPABLE or count != n:
            raise ValueError(f"{address} has no document index")
        body = self.file.read_at(9 * n, at + 16)
        null = np.frombuffer(body[8 * n :], np.uint8)
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(body[: 8 * n], "<i8"), null)]

    def read(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        frame = self.file.read_at(int(self.packed[k]), int(self.starts[k]))
        ids = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.sizes[k]))
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"document {k} fails its checksum")
        return np.frombuffer(ids, "<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes one file per range of ids into folder; gives a row per file: shard, path, n_docs, n_tokens."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer, n_docs, n_tokens = None, 0, 0
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        draft = f"{base}/.{shard}-{uuid.uuid4().hex}"
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc, ids in zip(part.column("id").to_pylist(), bpe_encoder(tokenizer_path).encode(part.column("text").to_pylist())):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        writer = TokenFileWriter(fs.open_output_stream(draft))
                    writer.add(doc, ids + end)
                    n_docs += 1
                    n_tokens += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            fs.move(draft, f"{base}/part-{shard:06d}.tokens")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/part-{shard:06d}.tokens"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return rows.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of files (shard, path, n_docs, n_tokens): id_col, start, n_tokens, ids_crc32.

    The running total over files is taken on the driver: one short row per file.
    """
    spark = files.sparkSession
    held, total = [], 0
    for r in files.orderBy("shard").select("path", "n_tokens").collect():
        held.append((r.path, total))
        total += r.n_tokens
    starts = spark.createDataFrame(held, "path string, start long").repartition(max(1, len(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(path)
                counts, sums = [], []
                for k in range(len(file.doc_ids)):
                    ids = file.read(k)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                before = start + np.concatenate(([0], np.cumsum(counts)[:-1])) if counts else []
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return starts.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark, sf_dir):
    folder = new_path(spark, "tokens")
    return read_token_files(staged(write_token_files(table(spark, sf_dir, "documents"), folder, bpe_path()), "token-files"))
