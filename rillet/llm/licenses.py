"""Licence scans: base phrases, and an exact set-similarity join with templates.

A text's words (runs of letters, digits and other characters, lower-cased in
ASCII) are cut into blocks, and a block matches a template when it holds at
least ``THRESHOLD`` of the template's distinct words. Blocks are as wide as a
template needs: ``BLOCK`` words, doubled until half a block holds the whole
template; they begin every half block, so that any words as many as the template
has share a block. Templates of one width share blocks; any length will do.
Tokens are ordered by their frequency in the whole corpus, rarest first; only
words of a template's prefix make candidates, which then pass the length filter
and the positional filter before their sets are intersected. The filters lose
nothing.

Null and empty texts have no words, labels '' and score 0. Very long texts have
more blocks; repeated rows are scanned one by one. ``score`` is the largest
containment of a matching template, 1 where a base phrase stands; of labels
that match equally well all are given. Empty tables give no rows. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import small_batches
from rillet.llm.textscan import ALNUM, Words, buffers, pieces

BLOCK, THRESHOLD = 96, 0.8
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A whole licence, in the words of its scans.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without
restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the
software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection
with the software or the use or other dealings in the software"""
BSD2 = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the
above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied
warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be
liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or
business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this
software even if advised of the possibility of such damage"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice
appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no
event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software"""
APACHE_NOTICE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org
licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
either express or implied see the license for the specific language governing permissions and limitations under the license"""
GPL_NOTICE = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of
the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
fitness for a particular purpose see the gnu general public license for more details"""
#: Label and words.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit-full", MIT), ("bsd-full", BSD2), ("isc-full", ISC), ("apache-header", APACHE_NOTICE), ("gpl-header", GPL_NOTICE),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def hashes(words: str) -> np.ndarray:
    raw = words.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM).hashes()


def scan_tokens(templates) -> np.ndarray:
    return np.unique(np.concatenate([hashes(t) for _, t in templates]))


def find(h: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``h`` of the keys, and which key each is."""
    low = np.searchsorted(sorted_keys, h)
    low[low == len(sorted_keys)] = 0
    at = np.flatnonzero(sorted_keys[low] == h) if len(sorted_keys) else np.empty(0, np.int64)
    return at, low[at]


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """How often each template token occurs in all texts: one row per task and token, summed."""
    small_batches(docs.sparkSession)
    tokens = scan_tokens(templates)

    def count(batches):
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, body, at in pieces(data, offsets):
                _, which = find(Words(body, at, ALNUM).hashes(), tokens)
                total += np.bincount(which, minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens), dtype=np.int32)), pa.array(total)], ["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(tokens[r.token]): r.n for r in rows}


class Templates:
    """Templates of one width of blocks, with their prefixes."""

    def __init__(self, block: int, templates, rank: dict[int, int], threshold: float):
        self.block, self.stride, self.rank = block, block // 2, rank
        self.labels, self.sets, self.need = [], [], []
        prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (label, text) in enumerate(templates):
            ordered = sorted({int(x) for x in hashes(text)}, key=rank.__getitem__)
            need = math.ceil(threshold * len(ordered) - 1e-9)
            self.labels.append(label), self.sets.append(ordered), self.need.append(need)
            for i, token in enumerate(ordered[: len(ordered) - need + 1]):
                prefix[token].append((k, i))
        self.prefix = prefix
        self.keys = np.array(sorted(prefix), np.uint64)

    def matches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, str, float]]:
        """row, first and last word of the block (within the row), label, containment."""
        at, which = find(h, self.keys)
        if not len(at):
            return []
        row = np.searchsorted(first, at, side="right") - 1
        seen, out, blocks = set(), [], {}
        for p, r, key in zip(at.tolist(), row.tolist(), self.keys[which].tolist()):
            place, n = p - int(first[r]), int(first[r + 1] - first[r])
            for b in {place // self.stride, max(place // self.stride - 1, 0)}:
                begin, end = b * self.stride, min(b * self.stride + self.block, n)
                if place >= end or begin and begin + self.stride >= n:
                    continue  # not in this block, or a tail that the block before holds whole
                for k, i in self.prefix[key]:
                    if (r, b, k) in seen:
                        continue
                    seen.add((r, b, k))
                    if (r, b) not in blocks:
                        held = set(h[first[r] + begin : first[r] + end].tolist())
                        blocks[r, b] = held, sorted(self.rank[t] for t in held if t in self.rank)
                    (held, ranks), need, size = blocks[r, b], self.need[k], len(self.sets[k])
                    if len(held) < need:
                        continue
                    before = sum(t in held for t in self.sets[k][:i])
                    if before + 1 + min(size - i - 1, len(ranks) - bisect_right(ranks, self.rank[key])) < need:
                        continue
                    share = sum(t in held for t in self.sets[k]) / size
                    if share * size >= need:
                        out.append((r, begin, end, self.labels[k], share))
        return out


class Scanner:
    """``groups``: the templates by the width of the blocks that they need."""

    def __init__(self, frequency: dict[int, int], templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK):
        words = [hashes(t) for _, t in templates]
        if not all(map(len, words)):
            raise ValueError("a template has no words")
        rank = {t: k for k, t in enumerate(sorted({int(x) for w in words for x in w}, key=lambda x: (frequency.get(x, 0), x)))}
        by: dict[int, list] = defaultdict(list)
        for w, template in zip(words, templates):
            width = block
            while width < 2 * len(w):
                width *= 2
            by[width].append(template)
        self.groups = [Templates(width, own, rank, threshold) for width, own in sorted(by.items())]

    def matches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, str, float]]:
        return [m for g in self.groups for m in g.matches(h, first)]


def phrase_starts(h: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(h == phrase[0])
    for k in range(1, len(phrase)):
        at = at[at + k < len(h)]
        at = at[h[at + k] == phrase[k]]
    row = np.searchsorted(first, at, side="right") - 1
    return at[at + len(phrase) <= first[row + 1]]


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the columns of the query, and its matching blocks."""
    phrases = [(hashes(p), label) for p, label in PHRASES.items()]

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            rows = []
            for i, j, body, at in pieces(data, offsets):
                words = Words(body, at, ALNUM)
                h, first = words.hashes(), words.first
                base = [(np.searchsorted(first, p, side="right") - 1, p, label) for phrase, label in phrases for p in [phrase_starts(h, first, phrase)]]
                found: dict[int, list[tuple[int, str]]] = defaultdict(list)
                for row, place, label in base:
                    for r, p in zip(row.tolist(), place.tolist()):
                        found[r].append((p - int(first[r]), label))
                blocks: dict[int, list] = defaultdict(list)
                for r, begin, end, label, share in scanner.matches(h, first):
                    blocks[r].append({"begin": begin, "end": end, "template": label, "containment": share})
                for r, n in enumerate(np.diff(first).tolist()):
                    hits, own = found.get(r, []), blocks.get(r, [])
                    names = {x for _, x in hits}
                    rows.append((n, len(hits), min((p for p, _ in hits), default=None), max((p for p, _ in hits), default=None), ",".join(sorted(names)), ",".join(sorted(names | {b["template"] for b in own})), 1.0 if hits else max((b["containment"] for b in own), default=0.0), own))
            block = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("template", pa.string()), ("containment", pa.float64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), block]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<begin:long,end:long,template:string,containment:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, Scanner(frequencies(docs))).drop("blocks")
