"""Quality by histogram gradient-boosted trees over document statistics.

Each text gives ``FEATURES`` numbers: shares of kinds of bytes, word and line
lengths, and how often words, pairs of words and lines repeat. Trees of depth
``DEPTH`` are grown level by level on histograms of ``BINS`` quantile bins, then
laid out as arrays in heap order, which numpy follows for a batch of rows and
all trees at once.

The fit uses at most ``ROWS`` labelled documents, those with the smallest hash
of doc_id; scores are computed for all rows and whole texts. Null and empty
texts have all statistics 0 and score like any row, texts of any length theirs.
Labels that are null or without a document teach nothing; for several labels of a
document the lowest counts, and of several texts the one with the smallest hash
teaches; with no labels, or empty tables, every score is 0.5. Repeated rows and
ids are scored one by one. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import Smallest, held_out, one_each, small_batches
from rillet.llm.textscan import NOT_SPACE, Words, buffers, mix, pieces

#: The most labelled documents on which the trees are fitted.
ROWS = 20_000
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST = 80, 5, 64, 0.15, 1.0, 5.0
THRESHOLD = 0.7

KINDS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r", b".", b",;:", b"!?", b"#$%&*@^~", b"|<>{}[]\\/=+_", b"'\"()-")):
    KINDS[list(_chars)] = _k
KINDS[0x80:0xC0], KINDS[0xC0:], KINDS[:9] = 12, 13, 14
NOT_BREAK = np.ones(256, bool)
NOT_BREAK[0x0A] = False
FEATURES = 16 + 17


def repeats(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the number of distinct hashes, and how often the most frequent occurs."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    owner = (key[new] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 16 + KINDS[data], minlength=16 * n).reshape(n, 16)
    words, lines = Words(data, offsets, NOT_SPACE), Words(data, offsets, NOT_BREAK)
    of, h, length = words.rows(), words.hashes(), words.end - words.start
    count = np.diff(words.first)
    per = lambda x, by=of: np.bincount(by, x, n)
    distinct, most = repeats(of, h, n)
    at = words.pairs()
    both, most2 = repeats(of[at], mix(h[at] * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + 1]), n)
    line_of, line_h, line_size = lines.rows(), lines.hashes(), lines.end - lines.start
    line_n = np.diff(lines.first)
    line_distinct, _ = repeats(line_of, line_h, n)
    kind0, kind1 = KINDS[data[words.start]], KINDS[data[words.end - 1]]
    safe = lambda a, b: a / np.maximum(b, 1)
    mean = safe(per(length), count)
    extra = [
        np.log1p(count), np.log1p(size), mean, np.sqrt(np.maximum(safe(per(length.astype(float) ** 2), count) - mean**2, 0)),
        safe(distinct, count), safe(most, count), safe(both, count - 1), safe(most2, count - 1), safe(per((h[at] == h[at + 1]).astype(float), of[at]), count - 1),
        safe(per(kind0 == 1), count), safe(per((kind1 == 8) | (kind1 == 9)), count), safe(per((length > 20)), count), safe(per(length == 1), count),
        line_n, safe(size, line_n), safe(line_distinct, line_n), safe(np.bincount(line_of, KINDS[data[lines.end - 1]] == 6, n), line_n),
    ]
    return np.column_stack([safe(kinds, size[:, None]), *extra])


def of_column(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    return np.vstack([np.empty((0, FEATURES)), *[statistics(body, at) for _, _, body, at in pieces(data, offsets)]])


class Trees:
    """feature, above, value: trees as rows, nodes in heap order; a row goes right where its feature exceeds ``above``."""

    def __init__(self, feature: np.ndarray, above: np.ndarray, value: np.ndarray, bias: float):
        self.feature, self.above, self.value, self.bias = feature, above, value, bias

    def scores(self, x: np.ndarray, step: int = 1024) -> np.ndarray:
        tree = np.arange(len(self.feature))[None, :]
        out = np.empty(len(x))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH if len(self.feature) else 0):
                node = 2 * node + 1 + (part[rows, self.feature[tree, node]] > self.above[tree, node])
            leaf = node - (2**DEPTH - 1)
            out[i : i + step] = self.bias + (self.value[tree, leaf].sum(1) if len(self.feature) else 0)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts logistic loss; every split is the best over the bins of all features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    n, f = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    raw = np.full(n, bias)
    feature, above, value = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feat, thr = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for depth in range(DEPTH):
            m, base = 2**depth, 2**depth - 1
            at = (((node - base)[:, None] * f + np.arange(f)) * BINS + bins).ravel()
            gs, hs = (np.cumsum(np.bincount(at, np.repeat(v, f), m * f * BINS).reshape(m, f, BINS), 2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + LAMBDA) + (gt - gs) ** 2 / (ht - hs + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(hs < LEAST / 4) | (ht - hs < LEAST / 4)] = 0
            best = gain.reshape(m, -1).argmax(1)
            for k in range(m):
                c, b = divmod(int(best[k]), BINS)
                if gain[k, c, b] > 1e-6 and b < len(edges[c]):
                    feat[base + k], thr[base + k] = c, edges[c][b]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - (2**DEPTH - 1)
        v = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + LAMBDA)
        raw += v[leaf]
        feature.append(feat), above.append(thr), value.append(v)
    return Trees(np.array(feature), np.array(above), np.array(value), bias)


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, rows: int = ROWS) -> Trees:
    """Learns from the labels whose doc_id isn't held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id", parts, part))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_y")).withColumn("_o", F.xxhash64("doc_id"))
    sample = known.orderBy("_o", "doc_id").limit(rows)  # the bound of what is broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y", "_o", F.xxhash64("text").alias("_h"))

    def features(batches):
        smallest = Smallest()
        for batch in batches:
            batch = smallest.of(batch, "doc_id", "_h")
            x = of_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), batch.column(3), batch.column(4), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "o", "h", "x"])

    found = chosen.mapInArrow(features, "doc_id long, y int, o long, h long, x binary")
    got = one_each(found, "doc_id", "h").toArrow().to_pylist()  # at most ``rows``
    got.sort(key=lambda r: (r["o"], r["doc_id"], r["x"]))
    empty = np.zeros((0, 1))
    if not got:
        return Trees(empty, empty, empty, 0.0)
    return boost(np.array([np.frombuffer(r["x"]) for r in got]), np.array([r["y"] for r in got], float))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(of_column(batch.column(1))))], ["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
