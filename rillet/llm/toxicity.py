"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, pairs of neighbours and pairs with one word
between them (skip-grams), lower-cased in ASCII and hashed to 2**BITS places;
words are runs of letters, digits and other characters, so punctuation never
hides one. A longer word also counts by its first ``STEMS`` bytes, which stand
for its inflected forms; a word or stem that a text has ``REPEATS`` times is one
feature more. Learning keeps a rate for every coordinate and an L1 penalty on all
but the intercept, which leaves few weights; only those travel to the executors.

The fit uses at most ``ROWS`` labelled documents of each class, those with the
smallest hash of doc_id, and ``FEATURES`` features, in one task. Where the bounds
change the classes' shares, the intercept gives it back, so scores hold for the
shares of all labels. Scores are computed for all rows and whole texts; null and
empty texts score the intercept, texts of any length their features. Labels that
are null or without a document teach nothing; for several labels of one document
the highest counts, and of several texts the one with the smallest hash teaches;
with no labels at all, or empty tables, every score is 0.5. Repeated rows and ids
are scored one by one. Columns pass through ``scored``, but one of the score's
name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import Smallest, held_out, lean, one_each, small_batches
from rillet.llm.textscan import ALNUM, Words, buffers, mix, pieces

BITS = 20
STEMS = (4, 5, 6, 7)
REPEATS = 3
#: The most labelled documents of a class on which the model is fitted.
ROWS = 4000
#: The most features, of all its documents together, from which the model learns; they are taken in the order of the documents' hashes.
FEATURES = 1 << 25
ALPHA, BETA, L1, L2, ROUNDS = 2.0, 1.0, 5.0, 0.0, 10
THRESHOLD = 0.7


def grams(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Row and hashed place of each word, stem, pair and skip-gram; and whether repeats count."""
    h, row = words.hashes(), words.rows()
    yield row, (h >> np.uint64(64 - BITS)).astype(np.int32), True
    for size in STEMS:
        at = np.flatnonzero(words.end - words.start > size)
        stem = mix(words.spans(words.start[at], words.start[at] + size) + np.uint64(size))
        yield row[at], (stem >> np.uint64(64 - BITS)).astype(np.int32), True
    for gap in (1, 2):
        at = words.pairs(gap)
        both = mix(h[at] * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + gap] + np.uint64(gap))
        yield row[at], (both >> np.uint64(64 - BITS)).astype(np.int32), False


AGAIN = (mix(np.arange(1 << BITS, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - BITS)).astype(np.int32)


def keys(words: Words, weights: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of all rows, (row << BITS) | place in order; with ``weights``, only those that have one."""
    found = [np.empty(0, np.int64)]
    for row, place, counted in grams(words):
        for at, least in ((place, 1), (AGAIN[place], REPEATS))[: 1 + counted]:
            own = row
            if weights is not None:
                hit = np.flatnonzero(weights[at])
                own, at = row[hit], at[hit]
            key = (own.astype(np.int64) << BITS) | at
            if least > 1:
                key, times = np.unique(key, return_counts=True)
                key = key[times >= least]
            found.append(key)
    return np.unique(np.concatenate(found))


class Model:
    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.places, self.weights, self.bias = places, weights, bias

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out

    def scores(self, column: pa.Array, dense: np.ndarray) -> np.ndarray:
        data, offsets = buffers(column)
        out = np.full(len(offsets) - 1, self.bias)
        for i, j, body, at in pieces(data, offsets):
            key = keys(Words(body, at, ALNUM), dense)
            out[i:j] += np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Follows the regularised leader over ``rows`` (their distinct places), ``ROUNDS`` times."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(7)

    def weights(at):
        zi, penalty = z[at], np.where(at == 1 << BITS, 0.0, L1)
        w = (np.sign(zi) * penalty - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= penalty, 0.0, w)

    for _ in range(ROUNDS):
        for k in rng.permutation(len(rows)):
            at = np.append(rows[k], 1 << BITS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(np.arange((1 << BITS) + 1))
    places = np.flatnonzero(every[:-1]).astype(np.int32)
    return Model(places, every[places].astype(np.float32), float(every[-1]))


def correction(totals: dict[int, int], used: dict[int, int]) -> float:
    """The log-odds of the classes' shares in all labels less those in what was learnt from."""
    if not all(n.get(y) for n in (totals, used) for y in (0, 1)):
        return 0.0
    kept = [used[y] / totals[y] for y in (0, 1)]
    return float(np.log(kept[0] / kept[1]))


def samples(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, rows: int = ROWS) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y, o, h, tie and places (int32) of what may be learnt from, at most ``2 * rows`` rows; and how many labels there are of each class."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", parts, part))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_y")).withColumn("_o", F.xxhash64("doc_id"))
    totals = {r["_y"]: r["count"] for r in known.where(F.col("_y").isin(0, 1)).groupBy("_y").count().collect()}
    first = [known.where(F.col("_y") == y).orderBy("_o", "doc_id").limit(rows) for y in (0, 1)]
    sample = first[0].unionByName(first[1])  # at most 2 * rows small rows
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y", "_o", F.xxhash64("text").alias("_h"))

    def features(batches):
        smallest = Smallest()
        for batch in batches:
            batch = smallest.of(batch, "doc_id", "_h")
            data, offsets = buffers(batch.column(1))
            out = []
            for i, j, body, at in pieces(data, offsets):
                key = keys(Words(body, at, ALNUM))
                cut = np.searchsorted(key, np.arange(j - i + 1) << BITS)
                flat = (key & ((1 << BITS) - 1)).astype(np.int32)
                out += [flat[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            tie = pa.array(list(map(zlib.crc32, out)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), batch.column(3), batch.column(4), tie, pa.array(out, pa.binary())], ["doc_id", "y", "o", "h", "tie", "places"])

    found = chosen.mapInArrow(lean(features), "doc_id long, y int, o long, h long, tie long, places binary")
    return one_each(found, "doc_id", "h"), totals


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, rows: int = ROWS, features: int = FEATURES) -> Model:
    """Learns from the labels whose doc_id isn't held out, in one task; the driver gets the weights alone."""
    taught, totals = samples(docs, labels, parts, part, rows)

    def learn(batches):
        places, y, left = [], [], features
        for batch in batches:
            if left < 0:
                break
            for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left -= len(raw) // 4
                if left < 0 and places:
                    break
                places.append(np.frombuffer(raw, np.int32)), y.append(label)
        model = ftrl(places, np.array(y)) if places else Model(np.empty(0, np.int32), np.empty(0, np.float32), 0.0)
        yield pa.RecordBatch.from_pydict({"places": pa.array([model.places.tobytes()], pa.binary()), "weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias], "none": pa.array([y.count(0)], pa.int64()), "some": pa.array([y.count(1)], pa.int64())})

    ordered = taught.select("y", "places", "o", "doc_id", "tie").repartition(1).sortWithinPartitions("o", "doc_id", "tie").select("y", "places")
    got = ordered.mapInArrow(lean(learn), "places binary, weights binary, bias double, none long, some long").collect()
    if not got:
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), 0.0)
    one = got[0]
    return Model(np.frombuffer(one.places, np.int32), np.frombuffer(one.weights, np.float32), one.bias + correction(totals, {0: one.none, 1: one.some}))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` (with a column text) and a column with each text's score."""
    docs = docs.drop(name)

    def score(batches):
        dense = model.dense()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at), dense))], [*batch.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(lean(score), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def score(batches):
        dense = model.dense()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1), dense))], ["doc_id", "score"])

    out = docs.mapInArrow(lean(score), "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
