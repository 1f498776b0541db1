"""Exact top-k search by inner product, with a pivot-distance index.

Vectors are quantised to whole numbers, floor(SCALE * x), and scored by integer
inner product: in doubles where every product of the table is below 2**53, in
64-bit integers below 2**62, beyond that in integers of any size. Ranks are then
still exact; a score that a long can't hold is given as the nearest one it can.

One more coordinate, sqrt(M - |x|^2) for candidates and 0 for queries, where M
is the largest squared norm, makes the nearest in Euclidean distance those with
the largest products. Distances are those of vectors divided by a power of two.

Index. Pivots are fitted on a bounded sample (``SAMPLE`` vectors, at most
``PIVOTS`` pivots); every vector is keyed by its nearest pivot and its distance
to it. A pivot's vectors are sorted by distance and cut into cells of about
``CELL`` vectors, inside which annuli of ``RING`` vectors follow one another.
Cells are counted by a histogram of distances, so there are at most ``PIVOTS *
STEPS`` of them at any size; a cell that holds more vectors than ``CELL`` has
parts of about that size, by hash of vec_id.

Search. Each query first scans a part of its nearest cell that holds k
candidates, which bounds its k-th score. It then visits only cells that the
triangle inequality doesn't exclude: the distance of a cell's vectors to the
query is at least that of the query to the pivot less the cell's outer radius, or
its inner radius less that. In a part its annuli are expanded from the nearest,
until the bound of all that are left exceeds the k-th distance. Bounds have slack
for rounding and ties go to the smaller vec_id, so results are exact.

Vectors that are null, or hold null or non-finite components, take no part;
components whose SCALE-fold isn't finite count as the largest double. An index
holds vectors of one dimension; ``nearest`` builds one for each dimension and
answers queries from that of theirs, one dimension after another. Empty vectors
score 0, empty tables give no rows. A query's own vec_id is no candidate. Rows
that repeat a vec_id are candidates of their own; a query id that repeats counts
once, by its smallest vector. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillet.scratch import cut, shared_dir

SCALE, TOP, EVERY = 64, 20, 20
#: Bounds of the sample on which pivots are fitted, and of the pivots, cells and annuli.
SAMPLE, PIVOTS, CELL, RING = 4096, 48, 16_384, 256
STEPS = 4096
LARGEST = float(np.finfo(np.float64).max)
#: Scores that a long can't hold are ordered by so many bytes.
WIDE = 320


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, an array of whole numbers as doubles, of the vectors that take part."""
    usable = vectors.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")

    def whole(x):
        y = F.greatest(F.least(SCALE * x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # beyond, every double is whole

    return usable.select("vec_id", F.transform("embedding", whole).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Product:
    """Integer inner products of whole numbers of at most ``peak`` in size, whose sums have ``dim`` terms."""

    def __init__(self, peak: float, dim: int):
        bits = 2 * np.log2(max(peak, 1.0)) + np.log2(max(dim, 1)) + 0.01
        self.kind = np.float64 if bits < 53 else np.int64 if bits < 62 else object
        self.least = -np.inf if self.kind is not np.int64 else -np.iinfo(np.int64).max
        self.shift = 2 * int(np.frexp(max(peak, 1.0))[1])

    def whole(self, x: np.ndarray) -> np.ndarray:
        if self.kind is not object:
            return x.astype(self.kind)
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of queries and candidates that ``whole`` gave."""
        if not x.shape[1]:
            return np.zeros((len(q), len(x)), self.kind)
        return q @ x.T

    def scaled(self, scores: np.ndarray) -> np.ndarray:
        """Scores as doubles, divided by the square of the vectors' scale; -inf where there is none."""
        if self.kind is not object:
            return np.where(scores == self.least, -np.inf, np.ldexp(scores.astype(np.float64), -self.shift))

        def one(v):
            if v == -np.inf:
                return v
            drop = max(int(v).bit_length() - 64, 0)
            return float(np.ldexp(float(int(v) >> drop), drop - self.shift))

        return np.array([one(v) for v in scores.ravel()], float).reshape(scores.shape)

    def columns(self, scores: np.ndarray) -> list[pa.Array]:
        """score, what orders scores beyond a long, and the scaled score."""
        if self.kind is not object:
            return [pa.array(scores.astype(np.int64)), pa.nulls(len(scores), pa.binary()), pa.array(self.scaled(scores), pa.float64())]
        most = (1 << 63) - 1
        wide = [(int(v) + (1 << 8 * WIDE - 1)).to_bytes(WIDE) for v in scores]
        return [pa.array([max(-most - 1, min(most, int(v))) for v in scores], pa.int64()), pa.array(wide, pa.binary()), pa.array(self.scaled(scores), pa.float64())]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def fit_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(11)
    pivots = sample[rng.permutation(len(sample))[:n]]
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(1)
        pivots = np.array([sample[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


class Cells:
    """pivot, lo, hi, count and parts of each cell; ``of`` maps pivot and distance step to a cell."""

    def __init__(self, counts: np.ndarray, width: float, size: int):
        pivot, lo, hi, count = [], [], [], []
        self.of = np.zeros(counts.shape, np.int32)
        for p, row in enumerate(counts):
            fill = None
            for s in np.flatnonzero(row).tolist():
                n = int(row[s])
                if fill is None or count[fill] + n > size:
                    fill = len(pivot)
                    pivot.append(p), lo.append(s * width), hi.append(0.0), count.append(0)
                hi[fill], count[fill] = (s + 1) * width, count[fill] + n
                self.of[p, s] = fill
        self.pivot, self.lo, self.hi, self.count = np.array(pivot, np.int32), np.array(lo), np.array(hi), np.array(count, np.int64)
        self.parts = -(-self.count // size)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k])
    if len(ids) > 4 * k:
        least = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(product: Product, qid: np.ndarray, q: np.ndarray, near: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, radius: np.ndarray, most: float, k: int):
    """The k best of one part for each query: its rows of (query, id, score).

    near: distance of each query to the pivot; bound: the least k-th score so
    far, scaled. The part's vectors are in order of radius; an annulus is scored
    for the queries that it may still serve, nearest annuli first.
    """
    edges = range(0, len(ids), RING)
    inner = np.array([radius[i] for i in edges])
    outer = np.array([radius[min(i + RING, len(ids)) - 1] for i in edges])
    gap = np.maximum(np.maximum(inner - near[:, None], near[:, None] - outer), 0)
    small = np.ldexp(q, -product.shift // 2)
    square, slack = (small * small).sum(1), 1e-6 * (1 + np.sqrt(most))
    q, x = product.whole(q), product.whole(x)
    top_id, top_score = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), product.least, product.kind)
    order = gap.argsort(1, kind="stable")
    alive = np.ones(len(q), bool)
    for step in range(len(inner)):
        ring = order[:, step]
        reach = np.sqrt(np.maximum(square + most - 2 * np.maximum(bound, product.scaled(top_score[:, -1])), 0)) * (1 + 1e-9) + slack
        alive &= gap[np.arange(len(q)), ring] <= reach  # later annuli are no nearer
        if not alive.any():
            break
        for r in np.unique(ring[alive]):
            who = np.flatnonzero(alive & (ring == r))
            lo = int(r) * RING
            c, s = ids[lo : lo + RING], product.scores(q[who], x[lo : lo + RING])
            s[qid[who][:, None] == c] = product.least
            every_id = np.concatenate([top_id[who], np.broadcast_to(c, s.shape)], 1)
            every = np.concatenate([top_score[who], s], 1)
            for row, w in enumerate(who):
                if s[row].max() < top_score[w, -1]:
                    continue
                at = best(every_id[row], every[row], k)
                top_id[w], top_score[w] = every_id[row][at], every[row][at]
    hit = top_score != product.least
    row, _ = np.nonzero(hit)
    return qid[row], top_id[hit], top_score[hit]


class Index:
    """An index of vectors of one dimension. ``share``, once a search has measured it: the visited share of all pairs of queries and parts of cells."""

    def __init__(self, vectors: DataFrame, folder: str, cell: int = CELL):
        vectors = vectors.withColumn("_d", F.size("v"))
        dims = vectors.groupBy("_d").count().orderBy(F.desc("count"), "_d").first()
        self.dim = dims[0] if dims else 0
        self.total = dims[1] if dims else 0
        vectors = vectors.where(F.col("_d") == self.dim).drop("_d")
        self.vectors, self.folder, self.size, self.share = vectors, folder, cell, None
        peak = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()[0] or 0.0
        self.product = product = Product(peak, self.dim)
        scale = product.shift // 2
        self.most = float(vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * F.lit(float(np.ldexp(1.0, -scale)))) * (x * F.lit(float(np.ldexp(1.0, -scale))))))).first()[0] or 0)
        share = min(1.0, SAMPLE / max(self.total, 1))
        chosen = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < round(share * (1 << 30))).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(2 * SAMPLE).toArrow()
        sample = np.ldexp(matrix(chosen.column("v").combine_chunks()), -scale) if chosen.num_rows and self.dim else np.zeros((1, max(self.dim, 0)))
        most, pivots = self.most, fit_pivots(lifted(sample, self.most))
        self.pivots, width = pivots, max(2 * np.sqrt(self.most), 1.0) * 1.001 / STEPS
        dim = self.dim

        def key(batches):
            for batch in batches:
                x = np.ldexp(matrix(batch.column(1)), -scale) if dim else np.zeros((batch.num_rows, 0))
                d = distances(lifted(x, most), pivots)
                p = d.argmin(1)
                r = d[np.arange(len(d)), p]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.int32)), pa.array(r), pa.array(np.minimum(r / width, STEPS - 1).astype(np.int32))], ["vec_id", "v", "pivot", "radius", "step"])

        keyed = cut(vectors.mapInArrow(key, "vec_id long, v array<double>, pivot int, radius double, step int"), folder, "keyed")
        # at most PIVOTS * STEPS rows, whatever the data
        counts = np.zeros((len(pivots), STEPS), np.int64)
        for r in keyed.groupBy("pivot", "step").count().collect():
            counts[r[0], r[1]] = r[2]
        self.cells = cells = Cells(counts, width, cell)

        def place(batches):
            for batch in batches:
                c = cells.of[np.asarray(batch.column(2)), np.asarray(batch.column(4))]
                ids = np.asarray(batch.column(0)).astype(np.uint64)
                part = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cells.parts[c]
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(part), *[batch.column(k) for k in (0, 1, 3)]], ["cell", "part", "vec_id", "v", "radius"])

        self.rows = keyed.mapInArrow(place, "cell int, part long, vec_id long, v array<double>, radius double")

    def wanted(self, queries: DataFrame, k: int, home: bool) -> DataFrame:
        """cell, part and near for each query (query_id, v, bound) and each part that it visits."""
        pivots, cells, most, dim, scale = self.pivots, self.cells, self.most, self.dim, self.product.shift // 2
        slack = 1e-6 * (1 + np.sqrt(most))

        def assign(batches):
            for batch in batches:
                q = np.ldexp(matrix(batch.column(1)), -scale) if dim else np.zeros((batch.num_rows, 0))
                for i in range(0, len(q), 256):
                    part = q[i : i + 256]
                    ids = np.asarray(batch.column(0))[i : i + 256].astype(np.uint64)
                    near = distances(np.column_stack([part, np.zeros(len(part))]), pivots)[:, cells.pivot]
                    gap = np.maximum(np.maximum(cells.lo - near, near - cells.hi), 0) - slack
                    enough = np.where(cells.count > k, gap, np.inf)
                    first = np.where(np.isfinite(enough.min(1)), enough.argmin(1), cells.count.argmax())
                    own = (ids % cells.parts[first].astype(np.uint64)).astype(np.int64)
                    if home:
                        row, cell = np.arange(len(part)), first
                        begin, end, skip = own, own, np.full(len(part), -1)
                    else:
                        bound = np.asarray(batch.column(2))[i : i + 256]
                        reach = np.sqrt(np.maximum((part * part).sum(1) + most - 2 * bound, 0)) * (1 + 1e-9) + slack
                        row, cell = np.nonzero(gap <= reach[:, None])
                        begin, end = np.zeros(len(row), np.int64), cells.parts[cell] - 1
                        skip = np.where(cell == first[row], own[row], -1)  # scanned already
                    kept = [batch.column(c).slice(i, len(part)).take(pa.array(row)) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *kept, pa.array(near[row, cell]), *map(pa.array, (begin, end, skip))], ["cell", "query_id", "v", "bound", "near", "begin", "end", "skip"])

        visits = queries.select("query_id", "v", "bound").mapInArrow(assign, "cell int, query_id long, v array<double>, bound double, near double, begin long, end long, skip long")
        return visits.withColumn("part", F.explode(F.sequence("begin", "end"))).where("part <> skip").select("cell", "part", "query_id", "v", "bound", "near")

    def visit(self, wanted: DataFrame, k: int, name: str) -> DataFrame:
        """query_id, vec_id, score, wide and scaled of the best of each visited part."""
        product, most, dim = self.product, self.most, self.dim

        def scan(key, left, right):
            names = ["query_id", "vec_id", "score", "wide", "scaled"]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64())], names)
            left, right = left.combine_chunks(), right.sort_by("radius")
            of = lambda t: matrix(t.column("v").combine_chunks()) if dim else np.zeros((t.num_rows, 0))
            x, ids, radius = of(right), np.asarray(right.column("vec_id")), np.asarray(right.column("radius"))
            q, qid, bound, near = of(left), np.asarray(left.column("query_id")), np.asarray(left.column("bound")), np.asarray(left.column("near"))
            got = [search(product, qid[i : i + 512], q[i : i + 512], near[i : i + 512], bound[i : i + 512], ids, x, radius, most, k) for i in range(0, len(q), 512)]
            return pa.table([pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got])), *product.columns(np.concatenate([g[2] for g in got]))], names)

        # a part that very many queries visit meets them in blocks, each with the part's own rows
        per = 4 * self.size
        loads = wanted.groupBy("cell", "part").count().select("cell", "part", F.expr(f"cast((count - 1) div {per} + 1 as int)").alias("blocks"))
        loads = cut(loads, self.folder, f"loads-{name}")
        asked = wanted.join(loads, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        held = self.rows.join(loads, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        at = ["cell", "part", "block"]
        return asked.groupBy(*at).cogroup(held.groupBy(*at)).applyInArrow(scan, "query_id long, vec_id long, score long, wide binary, scaled double")

    def top(self, queries: DataFrame, k: int = TOP, measure: bool = False) -> DataFrame:
        """query_id, rank, vec_id, score for ``queries`` (query_id, v)."""
        queries = queries.where(F.size("v") == self.dim).groupBy("query_id").agg(F.min("v").alias("v"))
        queries = cut(queries.withColumn("bound", F.lit(float("-inf"))), self.folder, "queries")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))).where(F.col("rank") <= k)
        if not len(self.cells.pivot):
            return queries.where("false").select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
        home = cut(self.visit(self.wanted(queries, k, True), k, "home"), self.folder, "home")
        bounds = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("scaled")).otherwise(float("-inf")).alias("least"))
        bounded = queries.join(bounds, "query_id", "left").select("query_id", "v", F.coalesce("least", "bound").alias("bound"))
        wanted = self.wanted(bounded, k, False)
        if measure:
            self.share = (wanted.count() + queries.count()) / max(queries.count() * int(self.cells.parts.sum()), 1)
        return ranked(home.unionByName(self.visit(wanted, k, "rest"))).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for ``queries`` (query_id, v) among the vectors of the same dimension.

    A query id that repeats in several dimensions counts once, by its smallest vector of all.
    """
    folder = shared_dir(vectors.sparkSession)
    dims = [r[0] for r in vectors.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").collect()]
    if len(dims) < 2:
        return Index(vectors, folder).top(queries, k)
    queries = cut(queries.groupBy("query_id").agg(F.min("v").alias("v")), folder, "asked")
    found = None
    for d in dims:
        under = f"{folder}/dim{d}"
        got = Index(vectors.where(F.size("v") == d), under).top(queries.where(F.size("v") == d), k)
        found = got if found is None else found.unionByName(got)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    vectors = cut(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), folder, "vectors")
    return nearest(vectors, vectors.where(f"vec_id % {EVERY} = 0").withColumnRenamed("vec_id", "query_id"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
