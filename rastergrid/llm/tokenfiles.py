"""Token-id files: one zstandard frame per document under a shared dictionary, with an offset index.

Layout of a file, little-endian: magic, version, SHA-256 of the dictionary; the frames; the index
(doc_id, has_id, frame end, token end, each one array over the documents); at the end the index
position, the number of documents and the magic again. A document is read by its two index entries
and its own frame.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastergrid.llm.common import relieved, text_runs, texts_of, tidy
from rastergrid.llm.encoding import TextEncoder, read_spec
from rastergrid.session import qualified, shared_dir
from rastergrid.sources.fs import open_fs, write_atomic

MAGIC = b"TOKZ"
HEAD, TAIL = "<4sI32s", "<QQ4s"
HEAD_SIZE, TAIL_SIZE = struct.calcsize(HEAD), struct.calcsize(TAIL)
END_ID = 2
DICTIONARY = "shared.dictionary"
MANIFEST = "manifest.json"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary for the samples; too few of them serve as its raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[:size]
        return raw if len(raw) >= 8 else b""


def _dictionary(content: bytes):
    return zstandard.ZstdCompressionDict(content) if content else None


def sample_ids(docs: DataFrame, spec: str, documents: int, words: int) -> list[bytes]:
    """Serialized ids of the ``documents`` texts with the least hashes in the whole table; of a long
    text the first ``words`` words, and ``8 * words`` characters at most, so what comes to the driver
    is bounded. They fit the dictionary only, which changes sizes, not contents."""
    texts = texts_of(docs).where("text <> ''").select(
        F.xxhash64("doc_id", "text").alias("lot"), F.substring("text", 1, 8 * words).alias("text"))
    total, asked, rows = docs.count(), 4 * documents, []
    while total:
        # Only rows with a hash in the lowest share of all are sorted, else each task would send its own
        # least; where too few of them have a text, the share grows up to the whole table.
        share = min(1.0, asked / total)
        low = texts.where(F.col("lot") <= F.lit(int(share * 2**64) - 2**63 - 1)).distinct()
        few = low.orderBy("lot", "text").limit(documents)
        rows = few.select(F.substring_index("text", " ", words).alias("text")).collect()
        if len(rows) == documents or share == 1.0:
            break
        asked *= 16
    ids, sizes = TextEncoder(spec).encode([r["text"] for r in rows])
    return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1]) if len(x)] if rows else []


class _Writer:
    """One file, written in order under a temporary name."""

    def __init__(self, path: str, dictionary: bytes, level: int):
        system, bare = open_fs(path)
        folder, name = posixpath.split(bare)
        system.create_dir(folder, recursive=True)
        self.system, self.path, self.draft = system, bare, posixpath.join(folder, f"_{uuid.uuid4().hex}.{name}")
        self.out = system.open_output_stream(self.draft)
        self.out.write(struct.pack(HEAD, MAGIC, 1, hashlib.sha256(dictionary).digest()))
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        self.at, self.tokens = HEAD_SIZE, 0
        self.ids, self.known, self.frame_ends, self.token_ends = [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.at, self.tokens = self.at + len(frame), self.tokens + len(ids) // 4
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.frame_ends.append(self.at)
        self.token_ends.append(self.tokens)

    def close(self) -> None:
        for values, kind in ((self.ids, "<i8"), (self.known, "u1"), (self.frame_ends, "<u8"),
                             (self.token_ends, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack(TAIL, self.at, len(self.ids), MAGIC))
        self.out.close()
        self.system.move(self.draft, self.path)


class TokenFile:
    """Documents of one file by position; only the index and the asked frames are read."""

    def __init__(self, path: str, dictionary: bytes):
        system, bare = open_fs(path)
        self.file = system.open_input_file(bare)
        size = self.file.size()
        magic, _, digest = struct.unpack(HEAD, self.file.read_at(HEAD_SIZE, 0))
        index, self.documents, end = struct.unpack(TAIL, self.file.read_at(TAIL_SIZE, size - TAIL_SIZE))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        raw, n = self.file.read_at(size - TAIL_SIZE - index, index), self.documents
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.known = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.frame_ends = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.token_ends = np.frombuffer(raw, "<u8", n, 17 * n).astype(np.int64)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def token_start(self, i: int) -> int:
        return int(self.token_ends[i - 1]) if i else 0

    def serialized(self, i: int) -> bytes:
        start = int(self.frame_ends[i - 1]) if i else HEAD_SIZE
        frame = self.file.read_at(int(self.frame_ends[i]) - start, start)
        return self.decompressor.decompress(frame) if frame else b""

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.serialized(i), "<u4")

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None,
                      end_id: int = END_ID, level: int = 3, dictionary_bytes: int = 65_536,
                      sample_documents: int = 512, sample_words: int = 2_000) -> str:
    """Encode every whole text and write its ids to files in ascending doc_id order; the folder.

    Rows are dealt by ranges of doc_id (nulls first, rows with the same id by a hash of the text),
    and each task encodes its range and writes one file, so ids exist only while they are written.
    The driver gets one row of counts per file and stores them as the manifest. The dictionary is
    trained on at most ``sample_documents`` texts of at most ``sample_words`` words.

    Null texts are empty; each document gets ``end_id`` behind its ids. Repeated rows are written as
    often as they come. An empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else shared_dir(spark) + "/tokens"
    spec = read_spec(tokenizer)
    dictionary = train_dictionary(sample_ids(docs, spec, sample_documents, sample_words), dictionary_bytes)
    write_atomic(f"{folder}/{DICTIONARY}", dictionary)
    shared = spark.sparkContext.broadcast((spec, dictionary))

    def write(batches):
        part, writer, encoder = TaskContext.get().partitionId(), None, None
        for batch in relieved(text_runs(batches), 4):
            if writer is None:
                encoder = TextEncoder(shared.value[0])
                writer = _Writer(f"{folder}/part-{part:06d}.tok", shared.value[1], level)
            ids, sizes = encoder.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            cuts = np.append(0, ends + np.arange(1, len(ends) + 1)).tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), cuts, cuts[1:]):
                writer.add(doc_id, ids[a:b].tobytes())
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "documents": pa.array([len(writer.ids)], pa.int64()),
                "tokens": pa.array([writer.tokens], pa.int64())})

    rows = texts_of(docs).withColumn("tie", F.xxhash64("text"))
    done = (rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
            .mapInArrow(tidy(write), "part int, documents long, tokens long").collect())
    files, start = [], 0
    for r in sorted(done, key=lambda r: r["part"]):
        files.append({"file": f"part-{r['part']:06d}.tok", "documents": r["documents"],
                      "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    manifest = {"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "files": files}
    write_atomic(f"{folder}/{MANIFEST}", json.dumps(manifest).encode())
    return folder


def _content(path: str) -> bytes:
    system, bare = open_fs(path)
    with system.open_input_file(bare) as f:
        return f.read()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files; ``ids`` is little-endian
    unsigned 32-bit, ``start`` counts the ids of all documents before it. One task per file."""
    files = json.loads(_content(f"{folder}/{MANIFEST}"))["files"]
    dictionary = spark.sparkContext.broadcast(_content(f"{folder}/{DICTIONARY}"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                file = TokenFile(f"{folder}/{files[n]['file']}", dictionary.value)
                for at in range(0, file.documents, 256):
                    some = range(at, min(at + 256, file.documents))
                    starts = [file.token_start(i) for i in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(file.doc_ids[i]) if file.known[i] else None for i in some], pa.int64()),
                        pa.array([files[n]["start"] + s for s in starts], pa.int64()),
                        pa.array([int(file.token_ends[i]) - s for i, s in zip(some, starts)], pa.int64()),
                        pa.array([file.serialized(i) for i in some], pa.binary())], schema=schema)
                file.close()

    return (spark.range(0, len(files), 1, max(1, len(files)))
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))


def read_document(folder: str, file: str, position: int) -> np.ndarray:
    """Ids of one document, without reading its neighbours."""
    found = TokenFile(f"{folder}/{file}", _content(f"{folder}/{DICTIONARY}"))
    try:
        return found.ids(position)
    finally:
        found.close()
