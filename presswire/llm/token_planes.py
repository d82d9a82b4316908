"""Token ids in a binary file format of shuffled planes.

Documents are range-partitioned by id (text hash within an id), sorted, and tokenized where they
lie; an end id follows every document. Each task writes its ids into files of about `file_ids`
ids. A file holds fixed-size blocks of ids; every block is transposed into byte planes (all
lowest bytes, then all second bytes ...) or bit planes, each plane is compressed with zstandard by
itself, and an index of the chunks and one of the documents close the file:

    magic | chunks ... | document index | chunk index | trailer

Files go to the shared folder under a name of their own per attempt; only those named by the
manifest, written after all tasks ended, count, so a lost executor or a repeated task leaves at
most an unread file. Reading decodes whole blocks, checks their number, and needs nothing but
the files and the manifest.

Tokenizing: a space after a character that is no white space always starts a new pre-token, so
a text is cut there, and each distinct cut is encoded once per worker by the tokenizers library
(bounded cache); a text with other white space before a space is encoded whole. The ids are
those of the whole text either way.

Defined cases: a null text counts as empty and has the end id only; a null doc_id is kept and
comes first; documents with one id are ordered by the hash of their text, and rows that repeat
get their own place; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from presswire.llm.common import open_store, pieces, written
from presswire.session import ship_package, work_path

MAGIC = b"PWPLANE1"
TRAILER = struct.Struct("<QQIIIHHB7x8s")  # ids, index offset, docs, blocks, block ids, planes, id bytes, kind, magic
CHUNK = np.dtype([("offset", "<u8"), ("length", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<u8"), ("n_tokens", "<u8")])

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
LEVEL = 3
CACHED_CUTS = 450_000
SLICE_BYTES = 4 << 20
END_ID = 0


# --- planes -----------------------------------------------------------------------------


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """A block of ids as `width` byte planes or 8 * `width` bit planes, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, bitorder="little")
    return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(raw.shape[1])]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=0, count=n, bitorder="little"), axis=1, bitorder="little")
    out = np.zeros((n, 4), np.uint8)
    out[:, :raw.shape[1]] = raw
    return out.view("<u4").ravel()


def pack_file(ids: np.ndarray, docs: np.ndarray, width: int, bits: bool, block_ids: int, level: int) -> bytes:
    """The bytes of a file of `ids` and its documents (`DOC` records)."""
    squeeze = zstandard.ZstdCompressor(level=level)
    body, chunks, at = [MAGIC], [], len(MAGIC)
    planes = width * (8 if bits else 1)
    blocks = range(0, len(ids), block_ids)
    for a in blocks:
        for plane in to_planes(ids[a:a + block_ids], width, bits):
            chunk = squeeze.compress(plane)
            chunks.append((at, len(chunk)))
            body.append(chunk)
            at += len(chunk)
    index = squeeze.compress(docs.tobytes())
    body += [index, np.array(chunks, CHUNK).tobytes(),
             TRAILER.pack(len(ids), at, len(docs), len(blocks), block_ids, planes, width, int(bits), MAGIC)]
    return b"".join(body)


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document records of a file."""
    n, at, n_docs, blocks, block_ids, planes, _, bits, magic = TRAILER.unpack(data[-TRAILER.size:])
    if magic != MAGIC or data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token planes")
    table = len(data) - TRAILER.size - blocks * planes * CHUNK.itemsize
    chunks = np.frombuffer(data, CHUNK, blocks * planes, table)
    expand = zstandard.ZstdDecompressor()
    docs = np.frombuffer(expand.decompress(data[at:table]), DOC) if n_docs else np.zeros(0, DOC)
    parts = []
    for b in range(blocks):
        own = chunks[b * planes:(b + 1) * planes]
        size = min(block_ids, n - b * block_ids)
        parts.append(from_planes(
            [expand.decompress(data[int(o):int(o) + int(length)]) for o, length in own], size, bool(bits)))
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    if len(ids) != n or len(docs) != n_docs:
        raise ValueError("a file of token planes is incomplete")
    return ids, docs


# --- tokenizing -------------------------------------------------------------------------


class CutEncoder:
    """Ids of whole texts, from the ids of their cuts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library finds these strings in a text before it cuts it: texts with one are encoded whole by it
        # as it comes, all others by one that does not look for them
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        # cuts seen lately, and those of the time before: what is met again moves up, the rest goes
        self.cache: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}

    def whole(self, texts: list[str], plain: bool = False) -> list[bytes]:
        tokenizer = self.plain if plain else self.tokenizer
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def learn(self, cuts: set[str]) -> None:
        if len(self.cache) > CACHED_CUTS:
            self.before, self.cache = self.cache, {}
        new = cuts.difference(self.cache)
        again = self.before.keys() & new
        self.cache.update((w, self.before[w]) for w in again)
        tight = []
        for w in new.difference(again):
            # white space before the next space: the cut may not be encoded by itself
            if not w or w[-1].isspace():
                self.cache[w] = None
            else:
                tight.append(w)
        self.cache.update(zip(tight, self.whole([" " + w for w in tight])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [t.split(" ") for t in texts]
        ends = [(c[0], c.pop() if len(c) > 1 else None) for c in cuts]
        self.learn(set().union(*(c[1:] for c in cuts)))
        firsts = self.whole([first for first, _ in ends])
        lasts = self.whole(["" if last is None else " " + last for _, last in ends])
        out, get = [], self.cache.__getitem__
        for text, c, first, last in zip(texts, cuts, firsts, lasts):
            loose = c[0] and c[0][-1].isspace() and len(c[0]) < len(text)
            if any(t in text for t in self.added):
                out.append(np.frombuffer(self.whole([text], plain=True)[0], self.kind))
                continue
            try:
                joined = None if loose else b"".join([first, *map(get, c[1:]), last])
            except TypeError:  # a cut that may not be encoded by itself
                joined = None
            out.append(np.frombuffer(self.whole([text])[0] if joined is None else joined, self.kind))
        return out


_ENCODERS: dict[str, CutEncoder] = {}


def encoder(path: str) -> CutEncoder:
    """One per worker process, so its cache serves all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CutEncoder(path)
    return _ENCODERS[path]


# --- writing and reading ----------------------------------------------------------------


def write_tokens(
    docs: DataFrame,
    folder: str,
    *,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    bits: bool = False,
    block_ids: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
    level: int = LEVEL,
) -> DataFrame:
    """Writes all documents to `folder`; returns the manifest (task, number, file, n_ids, n_docs)."""
    ordered = (
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                    F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer)
        width = work.kind.itemsize
        context = TaskContext.get()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        held, records, size, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"ids-{context.partitionId():06d}-{number:05d}-{uuid.uuid4().hex}.planes"
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            data = pack_file(ids, np.array(records, DOC), width, bits, block_ids, level)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict(
                {"task": [context.partitionId()], "number": [number], "file": [name],
                 "n_ids": [len(ids)], "n_docs": [len(records)]}, schema=MANIFEST)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for a, b in pieces(batch.column(1), SLICE_BYTES):
                part = batch.slice(a, b - a)
                for key, ids in zip(part.column(0).to_pylist(), work.encode(part.column(1).to_pylist())):
                    if size and size + len(ids) + 1 > file_ids:
                        yield flush()
                        held, records, size, number = [], [], 0, number + 1
                    records.append((key or 0, key is not None, size, len(ids) + 1))
                    held += [ids, end]
                    size += len(ids) + 1
        if records:
            yield flush()

    ship_package(docs.sparkSession)
    return written(ordered.mapInArrow(run, "task int, number int, file string, n_ids long, n_docs long"), "manifest")


MANIFEST = pa.schema([("task", pa.int32()), ("number", pa.int32()), ("file", pa.string()),
                      ("n_ids", pa.int64()), ("n_docs", pa.int64())])


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids of every document."""
    ship_package(spark)
    ids_type = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, docs = unpack_file(content.as_py())
                spans = list(zip(docs["start"].tolist(), docs["n_tokens"].tolist()))
                columns = [
                    pa.array([name] * len(docs), pa.string()),
                    pa.array(docs["doc_id"], mask=docs["known"] == 0),
                    pa.array(docs["start"].astype(np.int64)),
                    pa.array(docs["n_tokens"].astype(np.int64)),
                    pa.array([zlib.crc32(ids[s:s + n]) for s, n in spans], pa.int64()),
                ]
                names = ["file", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    ends = np.append(docs["start"], len(ids)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ordered = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file of millions of ids
    offsets = manifest.select(
        F.col("file").alias("of"), F.coalesce(F.sum("n_ids").over(ordered), F.lit(0)).alias("before"))
    if manifest.isEmpty():
        empty = f"file string, doc_id long, within long, n_tokens long, ids_crc32 long{ids_type}"
        found = spark.createDataFrame([], empty)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(folder)
        found = files.select(F.element_at(F.split("path", "/"), -1), "content").mapInArrow(
            run, f"file string, doc_id long, within long, n_tokens long, ids_crc32 long{ids_type}")
    return found.join(offsets, F.col("file") == F.col("of")).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def token_folder(spark: SparkSession) -> str:
    return work_path(spark, "token-planes")
