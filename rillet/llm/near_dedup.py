"""Near-duplicates by HyperMinHash, banding, and verification on full sets.

A document's set holds its distinct pairs of neighbouring words (white space
divides, A-Z lower-cased); one word alone is a set of one. Sets are kept as
64-bit hashes of their members, which take long words by a cryptographic
function, so that no known texts collide. Documents of equal sets (128 bits
more, and the size) form a class, which its smallest doc_id represents.

Each set is hashed once into 128 buckets. A register keeps, of the least hash in
its bucket, the number of leading zeros (6 bits) and the next 10 bits; empty
buckets borrow from others in a fixed random order. 32 bands of 4 registers are
keys: two sets of Jaccard 0.8 share none with probability (1 - 0.8**4)**32, or
5e-8; ``least_estimate`` bounds what is verified, which misses more (README). In
each band bucket the matching registers, corrected for accidental collisions,
estimate all Jaccards. The bucket proposes a maximum spanning forest of the
pairs that may reach the threshold, one pair less than it has members;
proposals are verified on the full sets of the whole texts.

Buckets where a proposal failed, so that members lie in different components,
aren't searched pair by pair: their members meet in an exact set-similarity
join (``prefix_pairs``). Each set's tokens are ordered by their frequency, the
rarest first; a pair that reaches the threshold shares one of the first ninth of
the smaller set's tokens and the first fifth of the larger one's. Sets that
share frequent boilerplate and differ in the rest share none of those, however
many there are. Pairs that do are verified on the texts.

Buckets of over ``limit`` classes are divided into blocks, all of which hold the
same few delegates; where those don't connect all blocks, the bucket goes to
the exact join as well. No bucket is capped, no task holds more than ``limit``
classes of one and some delegates, and a group of n near copies costs about n
verifications.

Sets of at most three members are linked with equal ones alone, so only classes
serve them. Null, empty and blank texts have empty sets, are linked with nothing
and stay. Rows that share a doc_id count as one document with the links of all
of them. Rows without a doc_id are linked with nothing and stay. Texts have no
bound. Empty tables give empty results. Other columns are not read; they pass
through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import join_groups, lean, marked, small_batches, without
from rillet.llm.components import stars
from rillet.llm.textscan import NOT_SPACE, Words, buffers, mix, pieces
from rillet.scratch import cut, shared_dir

BUCKETS, BANDS, MANTISSA = 128, 32, 10
#: A link: 100 * intersection >= 80 * union. Pairs of a lower estimate than ``least_estimate`` aren't verified, but for small sets.
PERCENT, LEAST_ESTIMATE, SMALL = 80, 0.58, 32
LIMIT = 1024
#: About so many members of a divided bucket are in all of its blocks.
DELEGATES = 16
#: Frequencies of tokens are counted in so many places by hash; any order of tokens finds all pairs.
PLACES = 1 << 16
#: The most classes, and about the most members of their sets, in a block of texts to verify.
BLOCK_DOCS, BLOCK_MEMBERS = 1024, 1 << 21
PROBES = np.array([np.random.default_rng(b).permutation(BUCKETS) for b in range(BUCKETS)])
STARTS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)


def sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit members of each text's set."""
    words = Words(data, offsets, NOT_SPACE)
    h, count = words.firm(), np.diff(words.first)
    out = []
    for first, n in zip(words.first.tolist(), count.tolist()):
        if n > 1:
            both = h[first : first + n]
            out.append(np.unique(mix(both[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + both[1:])))
        else:
            out.append(mix(h[first : first + n] + np.uint64(0x5851F42D4C957F2D)))
    return out


def of_column(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = buffers(column)
    for _, _, body, at in pieces(data, offsets):
        yield from sets(body, at)


def registers(members: np.ndarray) -> np.ndarray:
    """The compressed least hash of each bucket, which the top 7 bits name."""
    at = np.searchsorted(members, STARTS)
    held = members[np.minimum(at, len(members) - 1)]
    full = (at < len(members)) & (held >> np.uint64(57) == np.arange(BUCKETS, dtype=np.uint64))
    part, exponent = np.frexp(((held & np.uint64((1 << 57) - 1)) >> np.uint64(4)).astype(np.float64))
    zeros = np.where(part == 0, 63, 53 - exponent)
    out = (zeros.astype(np.uint16) << MANTISSA) | ((part * 2048).astype(np.int64) & 1023).astype(np.uint16)
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), full[probes].argmax(1)]]
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2 (a 128-bit hash of the set), regs (a long for each band)."""

    def run(batches):
        for batch in batches:
            n, s1, s2, regs = [], [], [], []
            for u in of_column(batch.column(1)):
                n.append(len(u))
                s1.append(mix(u).sum(dtype=np.uint64)), s2.append(mix(u ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
                regs.append(registers(u).view(np.int64) if len(u) else None)
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *[r for r in regs if r is not None]]))
            ends = np.cumsum([0, *[0 if r is None else BANDS for r in regs]]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), keys], ["doc_id", "n", "s1", "s2", "regs"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, regs array<long>")


def accidental(n: np.ndarray) -> np.ndarray:
    """For each pair of set sizes, the chance that registers of different hashes collide: equal leading zeros, then equal mantissas."""
    load = n[:, None] / BUCKETS
    level = np.arange(58)
    upper, lower = np.exp(-load * 0.5 ** (level + 1)), np.exp(-load * 0.5**level)
    p = upper - lower
    return p @ p.T / (1 << MANTISSA)


def least_estimate(n: np.ndarray) -> np.ndarray:
    """The estimate below which sets of which the larger has ``n`` members aren't verified.

    It is ``LEAST_ESTIMATE``, or five deviations below the threshold where that is lower. Of 128 registers, so many as
    there are full buckets differ; the others repeat one of them at random, which adds to the deviation of small sets.
    """
    full = BUCKETS * (1 - (1 - 1 / BUCKETS) ** np.maximum(n, 1))
    squares = ((BUCKETS - full) * (1 - 1 / full) + BUCKETS**2 / full) / BUCKETS**2  # of the registers' weights
    link = PERCENT / 100
    return np.minimum(LEAST_ESTIMATE, link - 5 * np.sqrt(link * (1 - link) * squares))


def likely(regs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many registers match, for pairs that may be links; else 0."""
    m = len(n)
    count = np.empty((m, m), np.uint8)
    for i in range(0, m, 64):
        count[i : i + 64] = (regs[i : i + 64, None, :] == regs[None, :, :]).sum(2)
    by_chance = accidental(n)
    estimate = (count / BUCKETS - by_chance) / (1 - by_chance)
    ok = (estimate >= least_estimate(np.maximum(n[:, None], n))) | (np.minimum(n[:, None], n) <= SMALL)
    ok &= 100 * np.minimum(n[:, None], n) >= PERCENT * np.maximum(n[:, None], n)
    np.fill_diagonal(ok, False)
    return np.where(ok, np.maximum(count, 1), 0)


def forest(weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """The edges of a maximum spanning forest."""
    m = len(weight)
    left = np.ones(m, bool)
    best, via = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for _ in range(m):
        k = int(np.where(left, best, -1).argmax())
        left[k] = False
        if best[k]:
            yield int(via[k]), k
        better = left & (weight[k] > best)
        best[better], via[better] = weight[k][better], k


def propose(members: DataFrame) -> DataFrame:
    """A forest of the pairs to verify in each block of each bucket."""
    at = ["band", "key", "sub"]
    ordered = members.select(*at, "rep", "n", "regs").repartition(*at).sortWithinPartitions(*at)

    def pairs(held: list) -> pa.RecordBatch:
        rep, n = (np.array([r[k] for r in held]) for k in (3, 4))
        found = list(forest(likely(np.array([r[5] for r in held], np.int64).view(np.uint16), n)))
        a, b = (rep[[p[k] for p in found]] if found else np.empty(0, np.int64) for k in (0, 1))
        same = [pa.array([held[0][k]] * len(found), t) for k, t in zip(range(3), (pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*same, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], [*at, "a", "b"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            flat = batch.column(5)
            regs = flat.flatten().to_numpy().reshape(-1, BANDS) if batch.num_rows else []
            for *row, r in zip(*columns, regs):
                if now != row[:3]:
                    if len(held) > 1:
                        yield pairs(held)
                    held, now = [], row[:3]
                held.append([*row, r])
        if len(held) > 1:
            yield pairs(held)

    return ordered.mapInArrow(lean(run), "band int, key long, sub long, a long, b long").where("a <> b")


def placed(members: DataFrame, folder: str) -> DataFrame:
    """doc_id, home and block of each class: those that share a bucket mostly share a home, the least class of their buckets; a large home has several blocks."""
    homes = cut(members.groupBy("rep").agg(F.min("lo").alias("home"), F.max("n").alias("n")), folder, "homes")
    blocks = homes.groupBy("home").agg(F.greatest(F.expr(f"(count(*) - 1) div {BLOCK_DOCS} + 1"), F.expr(f"sum(n) div {BLOCK_MEMBERS} + 1")).alias("blocks"))
    large = blocks.where("blocks > 1")
    return homes.join(large, "home", "left").select(F.col("rep").alias("doc_id"), "home", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).alias("block"))


def verified(pairs: DataFrame, texts: DataFrame, places: DataFrame, folder: str, name: str, spanning: bool = False) -> DataFrame:
    """``pairs`` (a, b) with link, from the whole texts (doc_id, text).

    A task has the pairs between two blocks and one text of each of their
    documents, however many pairs it is in; no task has more than two blocks.
    ``spanning``: of links that follow from others of the same task, only some.
    """
    side = lambda c: places.select(F.col("doc_id").alias(c), F.struct("home", "block").alias(f"at_{c}"))
    keyed = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    keyed = cut(keyed.select(F.xxhash64(F.least("at_a", "at_b"), F.greatest("at_a", "at_b")).alias("task"), "a", "b"), folder, f"{name}-pairs")
    wanted = keyed.select(F.col("task").alias("to"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bodies = wanted.hint("shuffle_merge").join(texts.select("doc_id", "text"), "doc_id").select("to", "doc_id", "text")

    def check(key, left, right):
        held: dict[int, list[np.ndarray]] = {}
        text = right.column("text")
        for i, u in zip(right.column("doc_id").to_pylist(), (u for part in text.chunks for u in of_column(part))):
            held.setdefault(i, []).append(u)
        a, b, link = left.column("a").to_pylist(), left.column("b").to_pylist(), []
        root: dict[int, int] = {}

        def find(i):
            while root.get(i, i) != i:
                root[i] = i = root.get(root[i], root[i])
            return i

        for i, j in zip(a, b):
            one, two = find(i), find(j)
            if spanning and one == two:
                link.append(False)
                continue
            link.append(any(linked(u, v) for u in held.get(i, ()) for v in held.get(j, ())))
            if link[-1]:
                root[one] = two
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "link": pa.array(link, pa.bool_())})

    return keyed.groupBy("task").cogroup(bodies.groupBy("to")).applyInArrow(check, "a long, b long, link boolean")


def linked(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two sets, sorted, reach the threshold."""
    if not len(u) or not len(v) or 100 * min(len(u), len(v)) < PERCENT * max(len(u), len(v)):
        return False
    every = np.concatenate([u, v])
    every.sort(kind="stable")
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return 100 * both >= PERCENT * (len(every) - both)


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the pairs' documents, and of a few others: told by a bitmap, without a shuffle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return marked(docs.select("doc_id", "text"), "doc_id", ids).where("_in").drop("_in")


def frequencies(texts: DataFrame) -> np.ndarray:
    """How often tokens occur in ``texts`` (doc_id, text), by place: at most ``PLACES`` rows of each task, summed."""

    def count(batches):
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for u in of_column(batch.column(1)):
                total += np.bincount((u & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "n"])

    out = np.zeros(PLACES, np.int64)
    got = texts.mapInArrow(lean(count), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out


def prefixes(u: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's first tokens in order of frequency, as far as any smaller set that it is linked with must share one, and how far a larger one must."""
    n = len(u)
    probe = n - -(-PERCENT * n // 100) + 1
    index = n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
    order = np.lexsort((u, frequency[(u & np.uint64(PLACES - 1)).astype(np.int64)]))
    return u[order[:probe]], index


def prefix_pairs(held: DataFrame, folder: str) -> DataFrame:
    """a, b: all pairs of different owners whose sets can reach the threshold, for ``held`` (doc_id, owner, text)."""
    frequency = frequencies(held.select("doc_id", "text"))

    def entries(batches):
        for batch in batches:
            tokens, sizes, places, lead = [], [], [], []
            for u in of_column(batch.column(2)):
                first, index = prefixes(u, frequency) if len(u) > 3 else (u[:0], 0)
                tokens.append(first), sizes.append(len(u)), lead.append(np.arange(len(first)) < index), places.append(np.arange(len(first), dtype=np.int32))
            if not tokens:
                continue
            row = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
            flat = [pa.array(np.concatenate(tokens).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(sizes, pa.int32()).take(row), pa.array(np.concatenate(places)), pa.array(np.concatenate(lead))]
            yield pa.RecordBatch.from_arrays(flat, ["token", "doc_id", "owner", "n", "place", "lead"])

    made = cut(held.select("doc_id", "owner", "text").mapInArrow(lean(entries), "token long, doc_id long, owner long, n int, place int, lead boolean"), folder, "entries")
    # tokens of one owner alone, or in no set's index, make no pairs
    telling = made.groupBy("token").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max("lead").alias("any")).where("lo <> hi and any").select("token")
    live = made.join(telling, "token")
    x = live.where("lead").select("token", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "owner", "n", "place")])
    y = live.select("token", *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "owner", "n", "place")])
    ordered = "(x_n < y_n or (x_n = y_n and x_doc_id < y_doc_id))"
    near = f"100L * x_n >= {PERCENT}L * y_n"
    enough = f"{100 + PERCENT}L * (least(x_place, y_place) + least(x_n - x_place, y_n - y_place)) >= {PERCENT}L * (x_n + y_n)"
    joined = x.hint("shuffle_merge").join(y, "token").where(f"x_owner <> y_owner and {ordered} and {near} and {enough}")
    return joined.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def divided(members: DataFrame, limit: int) -> DataFrame:
    """``members`` with sub, the block of their bucket; delegates of large buckets are in every block."""
    half = max(limit // 2, 1)
    blocks = F.expr(f"case when m <= {limit} then 1L else (m - 1) div {half} + 1 end")
    place = F.xxhash64("rep", "band", "key")
    delegate = (F.col("m") > limit) & (F.pmod(place, F.col("m")) < DELEGATES)
    own = F.array(F.pmod(F.xxhash64("rep", F.lit(2)), F.col("_blocks")))
    return members.withColumn("_blocks", blocks).withColumn("sub", F.explode(F.when(delegate, F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).otherwise(own))).drop("_blocks")


def unsettled(members: DataFrame, first: DataFrame, checked: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """doc_id and owner of the classes that may have links which their buckets' forests don't tell."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    failed = checked.where("not link").join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    open_ = first.join(failed, ["a", "b"]).select("band", "key").distinct()
    owned = lambda df: df.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("owner", F.coalesce("root", "rep"))
    large = owned(members.where(F.col("m") > limit).select("band", "key", "rep"))
    split = large.groupBy("band", "key").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo <> hi").select("band", "key")
    reps = members.select("band", "key", "rep").join(open_.unionByName(split).distinct(), ["band", "key"]).select("rep").distinct()
    return owned(reps).select(F.col("rep").alias("doc_id"), "owner")


def classes(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    small_batches(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    rows = cut(features(docs), folder, "features")
    real = rows.where("n > 0 and doc_id is not null")
    reps = cut(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("regs").alias("regs")), folder, "reps")
    banded = reps.where("n > 3").select("rep", F.posexplode("regs").alias("band", "key")).withColumn("bucket", F.xxhash64("band", "key"))
    # buckets of one member are counted by a hash and left out before anything else is shuffled
    several = cut(banded.groupBy("bucket").count().where("count > 1").select("bucket"), folder, "several")
    held = cut(marked(banded, "bucket", several).where("_in").select("rep", "band", "key"), folder, "banded")
    # buckets of the same members are compared once
    shared = held.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("rep").alias("lo"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND(0xFFFFFFFF)).alias("y")).where("m > 1")
    buckets = shared.groupBy("m", "lo", "x", "y").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key", "m", "lo")
    members = cut(held.join(cut(buckets, folder, "buckets"), ["band", "key"]), folder, "placed")
    known = marked(reps.select("rep", "n", "regs"), "rep", members.select("rep").distinct()).where("_in").drop("_in")
    members = cut(members.join(known, "rep"), folder, "members")
    compared = divided(members, limit)
    first = cut(propose(compared), folder, "first")
    texts = cut(texts_of(docs, first), folder, "texts")
    places = cut(placed(members, folder), folder, "places")
    checked = cut(verified(first, texts, places, folder, "first"), folder, "checked")
    found = checked.where("link").select("a", "b")
    roots = stars(found, folder, "roots")
    left = cut(unsettled(members, first, checked, roots, limit), folder, "unsettled")
    if not left.isEmpty():
        near = marked(docs.select("doc_id", "text"), "doc_id", left.select("doc_id")).where("_in").drop("_in")
        held = cut(near.join(left.hint("shuffle_merge"), "doc_id"), folder, "held")
        pairs = cut(prefix_pairs(held, folder).join(checked, ["a", "b"], "left_anti"), folder, "second")
        if not pairs.isEmpty():
            more = cut(verified(pairs, held, places, folder, "second", True), folder, "more").where("link").select("a", "b")
            roots = stars(found.unionByName(more), folder, "all")
    named = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", "copies", F.coalesce("root", "rep").alias("component_id"))
    named = cut(named, folder, "named")
    linked = join_groups(real.select("doc_id", "s1", "s2", "n"), named, ["s1", "s2", "n"], "copies", rows.count()).select("doc_id", "n", "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    rows = cut(classes(docs), shared_dir(docs.sparkSession), "classes")
    gone = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return without(docs, "doc_id", gone)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
