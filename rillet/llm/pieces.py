"""SentencePiece encoding that keeps each piece's place in the original bytes.

``Normalizer`` follows the model's compiled character map: at each place the
longest key of its double-array trie is replaced, other characters stay, and
every byte of the result records the original byte where its source begins.
``Encoder`` divides the normal form where no piece can span a border, takes the
library's ids for each part, remembers them, and projects the pieces onto the
original bytes. Its ids are those of the library for the whole text, and
``decode`` is the library's own.

Null and empty texts have no pieces. The texts' length has no bound besides a
row's; repeated rows are encoded like any, empty tables give none. Other columns
pass through ``encode`` and ``decode``, but those that they make are replaced. A model whose normal form removes
white space, or whose pieces hold white space after other characters, is coded
by the library alone and has no spans.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from rillet.llm.common import lean, small_batches
from rillet.llm.textscan import buffers

SPACE = "▁"
#: Texts are normalised in parts of about so many bytes, each of which takes some 100 bytes of memory.
WINDOW = 1 << 17
#: The most parts that a worker remembers; two workers share an executor's memory with its heap.
WORDS = 300_000
#: Parts of more characters aren't remembered, so that what is has a largest size (37 MB for the words of an ordinary corpus).
LONGEST = 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class Normalizer:
    """charsmap: trie size, double-array trie, zero-ended replacements, as in a model's normalizer_spec."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True):
        self.dummy_prefix, self.remove_extra, self.space = dummy_prefix, remove_extra, (SPACE if escape else " ").encode()
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4) if charsmap else np.empty(0, np.uint32)
        self.values = np.frombuffer(charsmap[4 + size :], np.uint8)
        self.stops = np.flatnonzero(self.values == 0)

    @classmethod
    def of_model(cls, model: bytes) -> Normalizer:
        spec = next((v for k, v in fields(model) if k == 3), b"")
        got = dict(fields(spec))
        return cls(got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1)))

    def longest(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place ``begin`` the replacement of the longest key there that goes no further than ``end``, or -1; and the key's length, or 0.

        All places take a step in the trie at once.
        """
        value, size = np.full(len(begin), -1), np.zeros(len(begin), np.int64)
        if not len(self.units):
            return value, size
        root = self.units[0]
        live, at = np.arange(len(begin)), begin
        node = np.full(len(begin), (root >> 10) << ((root & 512) >> 6), np.uint32)
        while len(live):
            inside = at < end[live]
            live, at, node = live[inside], at[inside], node[inside]
            byte = data[at]
            node = node ^ byte
            unit = self.units[node]
            on = unit & 0x800000FF == byte
            live, at, node, unit = live[on], at[on] + 1, node[on], unit[on]
            node = node ^ ((unit >> 10) << ((unit & 512) >> 6))
            leaf = unit >> 8 & 1 == 1
            found = live[leaf]
            value[found], size[found] = self.units[node[leaf]] & 0x7FFFFFFF, at[leaf] - begin[found]
        return value, size

    def forms(self, data: np.ndarray, bounds: np.ndarray, prefix: bool, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The normal forms of texts, which lie between ``bounds`` in ``data``, one after another in parts.

        A part has the place where its sources end, its bytes, and for each of
        them the place where its source (a key or a character) begins. White
        space isn't removed yet.
        """
        a = 0
        while a < len(data):
            b = min(a + window, len(data))
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            begin = a + np.flatnonzero(data[a:b] & 0xC0 != 0x80)
            size = np.diff(begin, append=b)
            value, length = self.longest(data, begin, bounds[np.searchsorted(bounds, begin, "right")] if len(self.units) else begin)
            upto, keep = b, np.ones(len(begin), bool)
            for k in np.flatnonzero(length > size).tolist():
                if keep[k]:
                    # a key of several characters hides the keys that begin within it
                    upto = int(begin[k] + length[k])
                    keep[k + 1 : np.searchsorted(begin, upto)] = False
            begin, size, value = begin[keep], size[keep], value[keep]
            # each source's bytes are those of the text, or those of its replacement
            pool = np.concatenate([data[a:b], self.values, np.array([0x20], np.uint8)])
            there = begin - a
            new = np.flatnonzero(value >= 0)
            there[new], size[new] = b - a + value[new], self.stops[np.searchsorted(self.stops, value[new])] - value[new]
            if prefix:
                first = bounds[slice(*np.searchsorted(bounds, (a, b)))]
                first = first[np.diff(first, append=-1) != 0]  # an empty text begins where the next does
                at = np.searchsorted(begin, first)
                begin, there, size = np.insert(begin, at, first), np.insert(there, at, len(pool) - 1), np.insert(size, at, 1)
            upper = np.cumsum(size)
            body = pool[np.repeat(there - upper + size, size) + np.arange(upper[-1] if len(upper) else 0)]
            where = np.repeat(begin, size)
            if len(self.space) > 1:
                wide = np.where(body == 0x20, len(self.space), 1)
                spaces = (np.cumsum(wide) - wide)[body == 0x20]
                body, where = np.repeat(body, wide), np.repeat(where, wide)
                body[spaces[:, None] + np.arange(len(self.space))] = np.frombuffer(self.space, np.uint8)
            a = max(b, upto)
            yield a, body, where

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form, and for each of its bytes (and its end) the place in ``text``."""
        if not text:
            return b"", np.zeros(1, np.int64)
        parts = list(self.forms(np.frombuffer(text, np.uint8), np.array([0, len(text)]), self.dummy_prefix and not self.remove_extra))
        body, places = b"".join(p[1].tobytes() for p in parts), np.concatenate([*[p[2] for p in parts], [len(text)]])
        if self.remove_extra:
            body, places = self.squeeze(body, places)
            if self.dummy_prefix and body:
                body, places = self.space + body, np.concatenate([np.full(len(self.space), places[0]), places])
        return body, places

    def squeeze(self, body: bytes, places: np.ndarray) -> tuple[bytes, np.ndarray]:
        keep = np.ones(len(body), bool)
        n, at, before = len(self.space), 0, True
        while at < len(body):
            if body[at : at + n] == self.space:
                keep[at : at + n] = not before
                before, at = True, at + n
            else:
                before, at = False, at + 1
        end = len(body)
        while end >= n and body[end - n : end] == self.space:
            keep[end - n : end] = False
            end -= n
        kept = np.flatnonzero(keep)
        return bytes(np.frombuffer(body, np.uint8)[kept]), np.append(places[kept], places[end] if end < len(body) else places[-1])


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normal = Normalizer.of_model(model)
        kinds, sizes, inner = [], [], False
        for k, v in fields(model):
            if k == 1:
                got = dict(fields(v))
                kinds.append(got.get(3, 1))
                # a piece for one byte stands for one byte of the normal form
                sizes.append(1 if kinds[-1] == 6 else len(got[1]))
                text = got[1].decode()
                inner |= kinds[-1] in (1, 4) and (SPACE in text.lstrip(SPACE) or "\n" in text)
        self.sizes, self.kinds = np.array(sizes, np.int32), np.array(kinds)
        bytewise = any(k == 6 for k in kinds)
        self.divides = bytewise and not inner and not len(self.normal.units) and not self.normal.remove_extra and self.normal.dummy_prefix and self.normal.space == SPACE.encode()
        if self.divides:
            ids = self.library.encode("\n")
            self.space_id, self.line_ids = ids[0], ids[1:]
            self.divides = ids[0] == self.library.piece_to_id(SPACE) and len(self.line_ids) == 1
        self.code = "H" if len(sizes) <= 1 << 16 else "I"
        self.names = list(map(str, range(len(sizes))))
        #: The ids of parts, as the bytes of an array.
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text and their decimal form, joined by commas."""
        if not self.divides:
            return [(x, ",".join(map(str, x))) for x in self.library.encode(texts, num_threads=1)]
        known, split = self.words, [self.borders(t) if t else [] for t in texts]
        new = list({p for ps in split for p in ps if p not in known})
        more = {}
        if new:
            more = self.unseen(new)
            known.update(islice((x for x in more.items() if len(x[0]) <= LONGEST), max(0, WORDS - len(known))))
        names, out = self.names, []
        for ps in split:
            try:
                got = b"".join([known[p] for p in ps])
            except KeyError:
                got = b"".join([known[p] if p in known else more[p] for p in ps])
            ids = array(self.code, got).tolist()
            out.append((ids, ",".join([names[x] for x in ids])))
        return out

    def borders(self, text: str) -> list[str]:
        """What stands between borders of the normal form, which is a space and the text.

        Borders lie before each space that follows another character, and
        around each line end. A part is written without its first space; one
        that has none, after a line end.
        """
        if "\n" not in text and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        out = []
        for k, line in enumerate(text.replace(SPACE, " ").split("\n")):
            if k:
                out.append("\n")
            words = line.split(" ")
            # words[0] has no space before it, but for the first line's
            run = 0 if k else 1
            for i, w in enumerate(words):
                run += i > 0
                if w:
                    out.append(("\n" + w) if run == 0 else " " * (run - 1) + w)
                    run = 0
            if run:
                out.append(" " * (run - 1))
        return out

    def unseen(self, parts: list[str]) -> dict[str, bytes]:
        """A part stands for a space and itself; one that begins with a line end, for what follows that, or for it alone."""
        got = self.library.encode(parts, num_threads=1)
        out = {}
        for p, ids in zip(parts, got):
            if p[:1] == "\n":
                ids = self.line_ids if p == "\n" else ids[2:]
            elif not p:
                ids = [self.space_id]
            out[p] = array(self.code, ids).tobytes()
        return out

    def spans(self, text: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The original bytes of each piece, begin and end; the prefix that the model adds has none."""
        begin, end, tiled = self.project([text], [ids])
        if not tiled.all():
            raise ValueError("pieces don't tile the normal form")
        return begin, end

    def project(self, texts: list[bytes], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of all texts' pieces, in bytes of their own text; and of each text whether its pieces tile its normal form.

        As in the library, a piece for one byte of a character begins where the
        character does, and only the last of them has its bytes. Where pieces
        don't tile, their places tell nothing.
        """
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        sizes = self.sizes[np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))]
        border = np.append(0, np.cumsum(sizes, dtype=np.int64))
        of = np.append(0, np.cumsum(count))
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        if self.normal.remove_extra:
            if len(texts) > 1:
                return self.each(texts, ids)
            body, place = self.normal(b"".join(texts))
            tiled = np.array([border[-1] == len(body)] * len(texts), bool)
            place = place[np.minimum(border, len(body))]
            return place[:-1], place[1:], tiled
        data = np.frombuffer(b"".join(texts), np.uint8)
        place, at = np.full(len(border), len(data)), np.empty(len(bounds), np.int64)
        done = n = 0
        for upto, body, where in self.normal.forms(data, bounds, self.normal.dummy_prefix):
            i, j = np.searchsorted(border, (n, n + len(body)))
            place[i:j] = where[border[i:j] - n]
            i, j = np.searchsorted(bounds, (done, upto))
            at[i:j] = n + np.searchsorted(where, bounds[i:j])
            done, n = upto, n + len(body)
        at[bounds == len(data)] = n
        tiled = border[of[1:]] - border[of[:-1]] == np.diff(at)
        if len(texts) > 1 and not tiled.all():
            return self.each(texts, ids)
        row = np.repeat(np.arange(len(texts)), count)
        return place[:-1] - bounds[row], np.minimum(place[1:], bounds[row + 1]) - bounds[row], tiled

    def each(self, texts: list[bytes], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``project``, one text after another."""
        begin, end, tiled = zip(*[self.project([t], [x]) for t, x in zip(texts, ids)])
        return np.concatenate(begin), np.concatenate(end), np.concatenate(tiled)

    def covered(self, texts: list[bytes], ids: list[list[int]]) -> list[bool]:
        """Whether each text's spans follow one another from its first byte to its last."""
        begin, end, whole = self.project(texts, ids)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        last = np.cumsum(count)
        row = np.repeat(np.arange(len(texts)), count)
        gap = np.flatnonzero((begin[1:] != end[:-1]) & (row[1:] == row[:-1]))
        whole[row[gap]] = False
        some = np.flatnonzero(count)
        whole[some] &= (begin[(last - count)[some]] == 0) & (end[last[some] - 1] == size[some])
        whole[count == 0] = size[count == 0] == 0
        return whole.tolist()

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts_of(batch: pa.RecordBatch, name: str, size: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    data, at = buffers(batch.column(batch.schema.get_field_index(name)))
    raw, i, n = data.tobytes(), 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, [raw[at[k] : at[k + 1]] for k in range(i, j)]
        i = j


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with pieces: an array of (id, begin, end), the places in bytes of the UTF-8 text.

    A column of that name is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("pieces")

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for i, j, rows in texts_of(batch, text):
                ids = [x for x, _ in code.encode([r.decode() for r in rows])]
                begin, end, tiled = code.project(rows, ids)
                if not tiled.all():
                    raise ValueError("pieces don't tile the normal form")
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(at[-1]))), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["id", "begin", "end"])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), flat)], [*part.schema.names, "pieces"])

    schema = docs.selectExpr("*", "cast(null as array<struct<id:int,begin:int,end:int>>) as pieces").schema
    return docs.mapInArrow(lean(run), schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array column of ids; null counts as empty. A column ``name`` is replaced."""
    docs = docs.drop(name) if name != ids else docs

    def run(batches):
        code = encoder(path)
        for batch in batches:
            rows = [x or [] for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.decode(rows) if rows else [], pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), docs.selectExpr("*", f"cast(null as string) as {name}").schema)


def digests(docs: DataFrame, path: str, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Encodes with spans, decodes, and returns digests of both with doc_id and the columns ``more``.

    ``covered``: the pieces' spans follow one another from the text's first byte to its last.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", *more)

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for i, j, rows in texts_of(batch, "text"):
                got = code.encode([r.decode() for r in rows])
                decoded = code.decode([ids for ids, _ in got])
                covered = code.covered(rows, [ids for ids, _ in got])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        *[batch.column(2 + k)[i:j] for k in range(len(more))],
                        pa.array([len(ids) for ids, _ in got], pa.int64()),
                        pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in got]),
                        pa.array([hashlib.sha256(s.encode()).hexdigest() for s in decoded]),
                        pa.array(covered),
                    ],
                    ["doc_id", *more, "n_tokens", "ids_sha256", "decoded_sha256", "covered"],
                )

    schema = docs.drop("text").selectExpr("*", "0L as n_tokens", "'' as ids_sha256", "'' as decoded_sha256", "true as covered").schema
    return docs.mapInArrow(lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
