"""Operator 8, token-id files: independent zstandard frames with a trailing seek table.

A file holds the token ids (little-endian unsigned 32-bit) of a range of documents in
ascending doc_id order, one zstandard frame a document, then two skippable frames: an index of
the documents, and a seek table in the layout of the zstandard seekable format:

    frame | frame | ... | document index | seek table
    document index: magic 0x184D2A50, u32 size, then per document u8 has an id, i64 doc_id
    seek table:     magic 0x184D2A5E, u32 size, then per frame u32 compressed size, u32 raw size,
                    u32 checksum (low 32 bits of xxh64 of the raw bytes),
                    then u32 number of frames, u8 flags 0x80, u32 magic 0x8F92EAB1

A reader opens the two tables at the end and decompresses only the frames it wants. The u32
sizes hold documents of up to 2**30 ids.

Scale: encoding is one pass; frames (not texts) are shuffled once, to the part whose range of ids they fall in, and each task
streams its sorted frames into files of at most ``DOCS_PER_FILE`` documents, holding one file's tables and a slice of a
batch. Parts are quantiles of doc_id, as many as the rows need; an id that many rows share (rows without id, say)
is cut by ranges of a hash of its contents. A file is written as a draft of its task attempt and renamed when complete, so
a repeated task replaces the same file; drafts that failed attempts left go with the drafts' folder. Files are numbered in two
levels, (part, file): the ids before a part come from totals of the parts, those before a file from totals inside its part.

Cases: null and empty text hold the end id alone; rows with equal ids stand side by side in
the order of a hash of their content; null ids come first; an empty table writes no file.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, map_arrow, shared_store, text_or_empty, work_path
from .pieces import WORD_LEVEL, PieceCache, text_slices

END_ID = 1
DOCS_PER_FILE = 8192
FILES_PER_PART = 4
#: Bytes of pre-tokens and ids that a worker keeps, from task to task.
KEPT_BYTES = 160 << 20
#: Bytes of texts that are encoded together.
TEXTS_AT_ONCE = 4 << 20
#: Frames that are Python objects at a time, in bytes.
FRAMES_AT_ONCE = 1 << 20
#: Subfolder of files that are not complete.
DRAFTS = "_drafts"
_LISTED = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_INDEX, _TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Encoder:
    """Ids as the library gives them, as raw bytes; distinct pre-tokens are encoded once a task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.cache = PieceCache(WORD_LEVEL, self._words, specials, lower=True, limit=KEPT_BYTES, weight=lambda values: sum(map(len, values)))
        end = self.library.model.end_of_word_suffix
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocab.items() if token.endswith(end)]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens: many in one text, parted by blanks, come apart again at the tokens that end a word."""
        out: list[bytes] = []
        for k in range(0, len(words), 5000):
            raw = self._raw([" ".join(words[k : k + 5000])])[0]
            at = np.r_[0, 4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)].tolist()
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        split, end = self.cache.pieces(texts), struct.pack("<I", end_id)
        known = self.cache.known
        whole = iter(self._raw([t for t, words in zip(texts, split, strict=True) if words is None]))
        return [(next(whole) if words is None else b"".join(map(known.__getitem__, words))) + end for words in split]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _order(ids: pa.Array) -> np.ndarray:
    """Ids as longs, null as the least."""
    return ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)


def part_of(ids: np.ndarray, hashes: np.ndarray, cut_ids: np.ndarray, cut_hashes: np.ndarray) -> np.ndarray:
    """The part of each (id, hash): how many of the sorted cuts are below it."""
    part = np.searchsorted(cut_ids, ids, "left")
    for i in np.unique(ids[part < np.searchsorted(cut_ids, ids, "right")]):  # ids that are cut inside
        low, high = np.searchsorted(cut_ids, i, "left"), np.searchsorted(cut_ids, i, "right")
        at = ids == i
        part[at] = low + np.searchsorted(cut_hashes[low:high], hashes[at], "left")
    return part


def part_cuts(docs: DataFrame, rows_per_part: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cuts (id, hash): quantiles of the ids, and even ranges of the hash inside ids of more rows than a part has."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    parts = -(-ids.count() // rows_per_part)
    if parts < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = 2**63 - 1
    found = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 5 * parts))).first()[0]
    cuts = {(i, last) for i in found}
    hot = ids.groupBy("id").count().where(F.col("count") > rows_per_part).collect()  # fewer than there are parts
    for r in hot:
        m = -(-r["count"] // rows_per_part)
        cuts |= {(r["id"], -(2**63) + k * (2**64 // m)) for k in range(1, m)} | {(r["id"], last)}
        if r["id"] > -(2**63):
            cuts.add((r["id"] - 1, last))
    pairs = sorted(cuts)
    return np.array([c[0] for c in pairs], np.int64), np.array([c[1] for c in pairs], np.int64)


def _frames(docs: DataFrame, tokenizer: str, end_id: int, cuts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of every document: the part it belongs to, doc_id, raw size, hash of the raw bytes and compressed frame."""

    def run(batches):
        ids, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, texts in text_slices(batch, "_text", TEXTS_AT_ONCE):
                raw, doc_ids = ids.encode(texts, end_id), part.column("doc_id")
                hashes = np.array([xxhash.xxh64_intdigest(x) - 2**63 for x in raw], np.int64)  # in unsigned order
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_of(_order(doc_ids), hashes, *cuts), pa.int32()), doc_ids, pa.array(list(map(len, raw)), pa.int64()),
                     pa.array(hashes, pa.int64()), pa.array([press.compress(x) for x in raw], pa.binary())],
                    ["part", "doc_id", "raw", "hash", "frame"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    return map_arrow(rows, run, "part int, doc_id long, raw long, hash long, frame binary")


def _name(part: int, file: int) -> str:
    return f"{part:07d}-{file:07d}.zst"


class _File:
    """One file while it is written."""

    def __init__(self, folder: str, part: int, number: int):
        self.fs, base = shared_store(folder)
        self.path, self.part, self.number = f"{base}/{_name(part, number)}", part, number
        self.draft = f"{base}/{DRAFTS}/{_name(part, number)}.{os.getpid()}-{os.urandom(4).hex()}"
        self.out, self.index, self.table, self.ids = self.fs.open_output_stream(self.draft), [], [], 0

    def add(self, doc_id, raw: int, checksum: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append(struct.pack("<Bq", doc_id is not None, doc_id or 0))
        self.table.append(struct.pack("<III", len(frame), raw, checksum))
        self.ids += raw // 4

    def close(self) -> dict:
        index, table = b"".join(self.index), b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index + struct.pack("<II", _TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.draft, self.path)
        return {"part": self.part, "file": self.number, "n_docs": len(self.table), "n_ids": self.ids}


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID,
                      docs_per_file: int = DOCS_PER_FILE, files_per_part: int = FILES_PER_PART) -> DataFrame:
    """Write the files; returns (part, file, n_docs, n_ids), one row a file. Call ``drop_drafts`` after its rows are stored."""
    cuts = part_cuts(docs, docs_per_file * files_per_part)
    fs, base = shared_store(folder)
    fs.create_dir(f"{base}/{DRAFTS}", recursive=True)

    def write(batches):
        now, done = None, []
        for batch in batches:
            for rows, frames in text_slices(batch, "frame", FRAMES_AT_ONCE):
                cols = [rows.column(n).to_pylist() for n in ("part", "doc_id", "raw", "hash")]
                for part, doc_id, raw, hashed, frame in zip(*cols, frames, strict=True):
                    if now is None or now.part != part or len(now.table) == docs_per_file:
                        number = 0
                        if now is not None:
                            done.append(now.close())
                            number = now.number + 1 if now.part == part else 0
                        now = _File(folder, part, number)
                    now.add(doc_id, raw, (hashed + 2**63) & 0xFFFFFFFF, frame)
            if done:
                yield pa.RecordBatch.from_pylist(done, _LISTED)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.close()], _LISTED)

    placed = _frames(docs, tokenizer, end_id, cuts).repartition("part")
    return map_arrow(placed.sortWithinPartitions("part", "doc_id", "hash", "raw"), write, "part int, file int, n_docs long, n_ids long")


def drop_drafts(folder: str) -> None:
    """Delete what failed attempts left."""
    fs, base = shared_store(folder)
    fs.delete_dir(f"{base}/{DRAFTS}")


class TokenFile:
    """Random access to one file: only the tables at its end are read up front."""

    def __init__(self, folder: str, part: int, number: int):
        fs, base = shared_store(folder)
        self.file = fs.open_input_file(f"{base}/{_name(part, number)}")
        size = self.file.size()
        tail = self._at(size - 9, 9)
        frames, flags, magic = struct.unpack("<IBI", tail)
        if magic != _SEEKABLE or flags != 0x80:
            raise ValueError("not a token file")
        table_at = size - 9 - 12 * frames - 8
        self.table = np.frombuffer(self._at(table_at + 8, 12 * frames), "<u4").reshape(frames, 3)
        index_at = table_at - 9 * frames
        index = np.frombuffer(self._at(index_at, 9 * frames), np.dtype([("has", "u1"), ("id", "<i8")]))
        self.ids = [int(i) if h else None for h, i in zip(index["has"], index["id"], strict=True)]
        self.at = np.r_[0, np.cumsum(self.table[:, 0].astype(np.int64))]
        self.press = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def raw(self, k: int) -> bytes:
        """The id bytes of the k-th document, checked."""
        found = self.press.decompress(self._at(int(self.at[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(found) != self.table[k, 1] or xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return found

    def tokens(self, doc_id) -> np.ndarray:
        return np.frombuffer(self.raw(self.ids.index(doc_id)), "<u4")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files named by ``files`` (part, file, n_docs, n_ids)."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that tiny rows are not put together
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("file"))), F.lit(0))
    starts = files.withColumn("inside", inside).join(parts, "part").select("part", "file", (F.col("first") + F.col("inside")).alias("first"))

    def read(batches):
        for batch in batches:
            for part, number, first in zip(*[batch.column(c).to_pylist() for c in ("part", "file", "first")], strict=True):
                file, out = TokenFile(folder, part, number), []
                for k, doc_id in enumerate(file.ids):
                    raw = file.raw(k)
                    out.append((doc_id, first, len(raw) // 4, zlib.crc32(raw)))
                    first += len(raw) // 4
                cols = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(starts.repartition(tasks, "part", "file"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "token-files")
    listing = work_path(spark, "token-files-list")
    write_token_files(documents(spark, sf_dir), default_tokenizer(), folder).write.parquet(listing)
    drop_drafts(folder)
    return read_token_files(spark.read.parquet(listing), folder)
