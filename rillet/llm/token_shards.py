"""Token ids in binary shards of separately compressed documents.

A shard is a header (magic, bytes per id, SHA-256 of the dictionary), one
zstandard frame per document, and an index with each document's id, frame
offset and number of ids, so that a document is read by its frame alone. All
frames share one dictionary, trained on serialised id arrays; it lies once
beside the shards, in a file named by its hash. Where the sample is too small to
train on, its ids themselves are the dictionary.

Shards follow one another in ascending doc_id order (null first, equal ids in
the order of their rows in the table of frames), and so do documents within
them. A task writes shards of ``SHARD_BYTES`` one after another; there are at
most ``MOST_TASKS`` tasks, and rows of one id may lie in several. A null or empty
text has only the end id; a very long text is one frame. ``SAMPLE`` bounds the
documents on which the dictionary is fitted, the first by hash, none of over
``SAMPLE_BYTES`` of ids; all documents are written. Empty tables give a
dictionary-less, shard-less archive. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillet.llm.common import small_batches
from rillet.llm.textscan import buffers
from rillet.scratch import cut, shared_dir

MAGIC = b"RILLET\0\1"
HEADER, TRAILER = "<8sI32s", "<QQ8s"
HEADER_SIZE, TRAILER_SIZE = struct.calcsize(HEADER), struct.calcsize(TRAILER)
INDEX = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u8")])
#: The most documents, and the most bytes of each one's ids, that train the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 17, 1 << 16
#: Samples of fewer distinct documents or bytes than this are themselves the dictionary.
LEAST_SAMPLES, LEAST_SAMPLE_BYTES = 64, 1 << 14
SHARD_BYTES = 32 << 20
#: The most tasks that write shards; beyond, each writes more of them.
MOST_TASKS = 20_000
#: Frames that lie together are read in windows of so many bytes.
WINDOW_BYTES = 8 << 20

WORDS = 700_000
PARTS = 600_000


class WordCoder:
    """The library's ids of whole texts, put together from those of words.

    No token holds white space and the special tokens take none with them, so a
    text's ids are those of its words in turn. Words are remembered as long as
    there is room; a new one is divided as the tokenizer's own pattern does, and
    its parts are remembered too. A word with letters beyond Latin, or whose
    normal form differs, goes to the library whole.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.type = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.part = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.plain = regex.compile(r"[\x21-ɏ]+")
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def pack(self, ids) -> bytes:
        return np.asarray(ids, self.type).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def parts_of(self, raw: bytes) -> list[str] | None:
        """The word's parts, or None if the library must have it whole."""
        word = raw.decode()
        if raw.isalpha():
            return [word.lower()]
        if "<|" in word or not self.plain.fullmatch(word) or not (raw.isascii() or unicodedata.is_normalized("NFC", word)):
            return None
        lower = word.lower()
        return [lower] if lower.isalpha() else self.part.findall(lower)

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        known, out, divided, unknown = self.parts, {}, [], {}
        for raw in new:
            parts = self.parts_of(raw)
            if parts is None:
                out[raw] = self.whole(raw.decode())
                continue
            divided.append((raw, parts))
            for p in parts:
                if p not in known:
                    unknown[p] = None
        if unknown:
            ids = np.asarray(self.tok.encode(" ".join(unknown), add_special_tokens=False).ids)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(unknown):
                body, ends = self.pack(ids), (ends * self.type.itemsize).tolist()
                unknown = {p: body[a:b] for p, a, b in zip(unknown, [0, *ends], ends)}
            else:
                unknown = {p: self.whole(p) for p in unknown}
            if len(known) < PARTS:
                known.update(unknown)
        for raw, parts in divided:
            out[raw] = b"".join([known[p] if p in known else unknown[p] for p in parts])
        if len(self.words) < WORDS:
            self.words.update(out)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        found = [list(map(self.words.get, words)) for words in split]
        new: set[bytes] = set()
        for words, got in zip(split, found):
            if None in got:
                new.update([w for w, x in zip(words, got) if x is None])
        if new:
            more = self.learn(list(new))
            found = [[more[w] if x is None else x for w, x in zip(words, got)] if None in got else got for words, got in zip(split, found)]
        return [b"".join(got) for got in found]


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int = 1 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Arrays of doc_id with the serialised ids of each row's text."""
    code = coder(path)
    end = code.pack([end_id])
    for batch in batches:
        data, at = buffers(batch.column(1))
        i, n, raw = 0, batch.num_rows, data.tobytes()
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            yield batch.column(0)[i:j], [x + end for x in code.encode([raw[at[k] : at[k + 1]] for k in range(i, j)])]
            i = j


def train(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from the ids of at most about ``SAMPLE`` documents, chosen by hash of doc_id."""
    total = docs.count()
    share = min(1.0, SAMPLE / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    chosen = docs.where(place < F.lit(round(share * (1 << 30)))).orderBy(place, "doc_id", F.xxhash64("text"), "text").limit(2 * SAMPLE)

    def ids(batches):
        for _, rows in encoded(batches, path, end_id):
            yield pa.RecordBatch.from_pydict({"ids": pa.array(rows, pa.binary())})

    samples = sorted(bytes(r.ids) for r in chosen.mapInArrow(ids, "ids binary").where(F.octet_length("ids") <= SAMPLE_BYTES).collect())
    if len(set(samples)) >= LEAST_SAMPLES and sum(map(len, samples)) >= LEAST_SAMPLE_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too much alike to train on
    return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_of(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write(docs: DataFrame, folder: str, path: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``docs`` (doc_id, text) below ``folder``; returns the manifest, one row per shard.

    A shard's name is new with each attempt at its task and only those of
    finished tasks reach the manifest, so lost executors leave no wrong data.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    dictionary = train(docs, path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    system, root = place(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{digest.hex()}.dict") as f:
        f.write(dictionary)
    width = coder(path).type.itemsize

    def compress(batches):
        pack = zstandard.ZstdCompressor(level=3, dict_data=dictionary_of(dictionary), write_content_size=True, write_dict_id=False, write_checksum=False).compress
        row = TaskContext.get().partitionId() << 40
        for ids, rows in encoded(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([ids, pa.array(range(row, row + len(rows)), pa.int64()), pa.array([len(x) // width for x in rows], pa.int64()), pa.array([pack(x) for x in rows], pa.binary())], ["doc_id", "row", "n", "frame"])
            row += len(rows)

    frames = cut(docs.mapInArrow(compress, "doc_id long, row long, n long, frame binary"), folder, "frames")
    size = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    spark = docs.sparkSession
    n_tasks = min(max(1, -(-size // shard_bytes), min(spark.sparkContext.defaultParallelism, size >> 20)), MOST_TASKS)

    def shard(batches):
        system, root = place(folder)
        task, number = TaskContext.get().partitionId(), 0
        out, index, at = None, [], 0

        def finish():
            rows = np.concatenate(index)
            out.write(rows.tobytes())
            out.write(struct.pack(TRAILER, at, len(rows), MAGIC))
            out.close()
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "shard": pa.array([number], pa.int32()), "path": [name], "n_docs": pa.array([len(rows)], pa.int64()), "n_ids": pa.array([int(rows["n"].sum())], pa.int64()), "dictionary": [digest.hex()]})

        for batch in batches:
            body, ends = buffers(batch.column(2).cast(pa.large_binary()))
            begin = 0
            while begin < batch.num_rows:
                if out is None:
                    name, at, index = f"{root}/{task:08d}-{number:06d}-{uuid.uuid4().hex}.ids", HEADER_SIZE, []
                    out = system.open_output_stream(name)
                    out.write(struct.pack(HEADER, MAGIC, width, digest))
                # as many rows as the shard has room for, one at least
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + shard_bytes - (at - HEADER_SIZE), side="right")) - 1)
                rows, ids = np.zeros(end - begin, INDEX), batch.column(0)[begin:end]
                rows["null"], rows["doc_id"] = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                rows["n"] = np.asarray(batch.column(1)[begin:end])
                rows["offset"], rows["size"] = at + ends[begin:end] - ends[begin], np.diff(ends[begin : end + 1])
                out.write(body[ends[begin] : ends[end]].tobytes())
                at += int(ends[end] - ends[begin])
                index.append(rows)
                begin = end
                if at - HEADER_SIZE >= shard_bytes or begin < batch.num_rows:
                    yield finish()
                    out, number = None, number + 1
        if out is not None:
            yield finish()

    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = frames.repartitionByRange(int(n_tasks), *order).sortWithinPartitions(*order).select("doc_id", "n", "frame")
    return cut(ordered.mapInArrow(shard, "task int, shard int, path string, n_docs long, n_ids long, dictionary string"), folder, "manifest")


class Shard:
    """Reads one shard; ``shard[k]`` reads and decompresses only its k-th document, ``documents`` all of them in windows."""

    def __init__(self, path: str, dictionaries: dict[str, bytes] | None = None):
        system = fs.LocalFileSystem() if path.startswith("/") else place(path)[0]
        self.file = f = system.open_input_file(path)
        magic, width, digest = struct.unpack(HEADER, f.read_at(HEADER_SIZE, 0))
        at, n, end = struct.unpack(TRAILER, f.read_at(TRAILER_SIZE, f.size() - TRAILER_SIZE))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is no complete shard")
        self.index = np.frombuffer(f.read_at(n * INDEX.itemsize, at), INDEX)
        known = dictionaries if dictionaries is not None else {}
        if digest.hex() not in known:
            with system.open_input_file(f"{path.rpartition('/')[0]}/{digest.hex()}.dict") as d:
                known[digest.hex()] = d.read()
        dictionary = known[digest.hex()]
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{path}: its dictionary was changed")
        self.type = np.dtype(f"<u{width}")
        self.unpack = zstandard.ZstdDecompressor(dict_data=dictionary_of(dictionary)).decompress

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *error) -> None:
        self.file.close()

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, k: int) -> np.ndarray:
        row = self.index[k]
        return np.frombuffer(self.unpack(self.file.read_at(int(row["size"]), int(row["offset"]))), self.type)

    def documents(self, window: int = WINDOW_BYTES) -> Iterator[np.ndarray]:
        offset, size = self.index["offset"].astype(np.int64), self.index["size"].astype(np.int64)
        ends, i = offset + size, 0
        while i < len(offset):
            j = max(i + 1, int(np.searchsorted(ends, offset[i] + window, side="right")))
            data = self.file.read_at(int(ends[j - 1] - offset[i]), int(offset[i]))
            for a, b in zip((offset[i:j] - offset[i]).tolist(), (ends[i:j] - offset[i]).tolist()):
                yield np.frombuffer(self.unpack(data[a:b]), self.type)
            i = j


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    Starts come from running sums over the writing tasks, of which there are
    ``MOST_TASKS`` at most, and over each one's shards, and from the shards' own
    indexes. A task reads about as many shards as a writing task wrote.
    """
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.join(tasks, "task").withColumn("base", F.col("_base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    n = max(manifest.sparkSession.sparkContext.defaultParallelism, min(manifest.count(), MOST_TASKS), 1)
    held = starts.select("task", "shard", "path", "base").repartition(n, "task", "shard")

    def rows(batches):
        dictionaries: dict[str, bytes] = {}
        for batch in batches:
            for path, base in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                with Shard(path, dictionaries) as shard:
                    n = shard.index["n"].astype(np.int64)
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.documents()]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.index["doc_id"].astype(np.int64), mask=shard.index["null"] > 0), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return held.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), 2))
