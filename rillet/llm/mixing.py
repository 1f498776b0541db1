"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's size is its number of words. Sources, in order of code points with
null last, weigh 3, 1, 2 and again; they share ``SHARE`` of all words, none over
``CAP`` times its own: the excess goes to the others by weight. Each source's
documents are permuted by a hash of their id and text and laid end to end,
``CAP`` times over; that stream is cut into blocks, at least sixteen to a round.

The tree divides the exact numbers of blocks that the sources owe among output
shards, half by half, each time by a multivariate-hypergeometric draw; the
stream's other blocks are divided along in proportion. So every shard has a
stretch of each source's stream, disjoint from those of other shards, and draws
its number of blocks as a run from it, at a random place; it is shuffled by
itself. The last block that a source draws is cut to its target, so each source
gives its target to a word. Running sums are kept per source and hash prefix, so
no task has a whole source.

Null and empty texts have size 0 and are never taken; null sources are a source.
Rows of one doc_id and size are interchangeable in ``documents``; ``mixed`` tells
all rows apart by all their columns, and takes rows equal in all of them as often
as all together are drawn. An empty table gives an empty mix. Long texts lie in
several blocks. Other columns pass through ``mixed``, whatever their names. Draws
depend on ``SEED`` and the data alone. The driver holds a row for each source,
which may be ``MOST_SOURCES`` (more are an error), and at most ``MOST_BLOCKS`` runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillet.llm.common import fingerprint, marked
from rillet.scratch import cut, shared_dir

SHARE, CAP, SEED = 1.5, 2, 20
PRINTS = ["_print1", "_print2"]
BLOCK_WORDS, SHARD_BLOCKS = 4096, 512
#: Of large sources there are so many blocks at most in all; blocks grow to hold more. Sources of few words have ``LEAST_BLOCKS`` a round.
MOST_BLOCKS, LEAST_BLOCKS = 2_000_000, 16
#: Nor are there more shards than this; beyond, each gets more blocks.
MOST_SHARDS = 200_000
MOST_SOURCES = 1_000_000


def sized(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, skey, size and key of each row; ``rows``: with the fingerprint of all its columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    skey = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("z"))
    key = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64(text).cast("string")).cast("binary"))
    prints = [c.alias(n) for c, n in zip(fingerprint(docs), PRINTS)] if rows else []
    return docs.select("doc_id", skey.alias("skey"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), key.alias("key"), *prints)


def targets(rows: DataFrame) -> DataFrame:
    """skey, source_size, target, words: one row per source, so one task can order them."""
    sums = rows.groupBy("skey").agg(F.sum("size").alias("s"))
    # null's key sorts after every other: 's...' < 'z'
    place = F.row_number().over(Window.orderBy("skey"))
    weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), ((place - 1) % 3 + 1).cast("int"))
    ranked = sums.withColumn("w", weight)
    every, before = Window.partitionBy(), Window.orderBy(F.expr("s * 6 div w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"t": F.sum("s").over(every).cast("double"), "ws": F.sum("w").over(every), "cs": F.coalesce(F.sum("s").over(before), F.lit(0)), "cw": F.coalesce(F.sum("w").over(before), F.lit(0))})
    ranked = ranked.withColumn("full", F.expr("4.0D * s * (ws - cw) <= w * (3.0D * t - 4.0D * cs)"))
    level = F.expr("(1.5D * t - 2.0D * coalesce(sum(case when full then s end) over (), 0)) / nullif(ws - coalesce(sum(case when full then w end) over (), 0), 0)")
    target = F.when(F.col("full"), 2.0 * F.col("s")).otherwise(F.col("w") * level)
    return ranked.select("skey", F.col("s").alias("source_size"), target.alias("target")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))


def laid(rows: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """``rows`` with rid (unique in its source and bucket), and begin, the words of the source before it."""
    digits = 1
    while total > 50_000 * 16**digits and digits < 8:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("b"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("base")).join(sources, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", *[c for c in PRINTS if c in rows.columns])
    rows = rows.withColumns({"rid": F.row_number().over(within), "off": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return rows.join(sums, ["skey", "bucket"]).withColumn("begin", F.col("base") + F.col("off")).drop("base", "off")


def split(quotas: np.ndarray, pools: np.ndarray, shards: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """shard, source, begin and count of each run of blocks drawn.

    The counts of a source add up to its quota, runs lie apart in its pool, and
    shards' counts differ by one at most. A branch holds only sources that still
    owe it blocks.
    """
    rng = np.random.default_rng(seed)
    total = int(quotas.sum())
    sizes = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    some = np.flatnonzero(quotas)
    todo = [(0, shards, some, quotas[some].astype(np.int64), np.zeros(len(some), np.int64), (pools - quotas)[some].astype(np.int64))]
    out = []
    while todo:
        a, b, who, left, lo, spare = todo.pop()
        if not len(who):
            continue
        if b - a == 1:
            out.append((np.full(len(who), a), who, lo + rng.integers(0, spare + 1), left))
            continue
        m = (a + b) // 2
        here = int(sizes[a:m].sum())
        draw = rng.multivariate_hypergeometric(left, here, method="marginals")
        share = (spare * (here / max(int(left.sum()), 1))).astype(np.int64)
        for c, d, n, at, free in ((m, b, left - draw, lo + draw + share, spare - share), (a, m, draw, lo, share)):
            held = np.flatnonzero(n)
            todo.append((c, d, who[held], n[held], at[held], free[held]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(4))


def block_size(sources: DataFrame, block_words: int) -> DataFrame:
    return sources.withColumn("block_words", F.least(F.lit(block_words).cast("long"), F.greatest(F.expr(f"source_size div {LEAST_BLOCKS}"), F.lit(1).cast("long"))))


def assigned(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """skey, block, shard and words of every block drawn, from ``sources`` (skey, source_size, words, block_words)."""
    got = sources.select("skey", "source_size", "words", "block_words").orderBy("skey").limit(MOST_SOURCES + 1).collect()
    if len(got) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    size, words, block = (np.array([r[k] for r in got], np.int64) for k in (1, 2, 3))
    pools = CAP * size // block if len(got) else size
    quotas = np.minimum(-(-words // np.maximum(block, 1)), pools)
    shards = min(max(1, -(-int(quotas.sum()) // shard_blocks)), MOST_SHARDS)
    shard, who, begin, count = split(quotas, pools, shards)
    order = np.lexsort((begin, who))
    shard, who, begin, count = (x[order] for x in (shard, who, begin, count))
    final = block[who].copy()
    last = np.flatnonzero(np.append(who[1:] != who[:-1], True)) if len(who) else who
    final[last] -= np.maximum((quotas * block - words)[who[last]], 0)
    # what a source owes beyond its whole blocks lies at the stream's end
    rest = np.flatnonzero(words > pools * block)
    at = np.zeros(len(got), np.int64)
    at[who[last]] = shard[last]
    names = pa.array([r.skey for r in got], pa.string()).take(pa.array(np.concatenate([who, rest]).astype(np.int64)))
    columns = [np.concatenate(c).astype(np.int64) for c in ((shard, at[rest]), (begin, pools[rest]), (begin + count - 1, pools[rest]), (final, (words - pools * block)[rest]), (block[who], block[rest]))]
    table = sources.sparkSession.createDataFrame(pa.Table.from_arrays([names, *map(pa.array, columns)], ["skey", "shard", "lo", "hi", "final", "full"]))
    runs = table.withColumn("block", F.explode(F.sequence("lo", "hi")))
    return runs.select("skey", "block", F.col("shard").cast("int").alias("shard"), F.when(F.col("block") == F.col("hi"), F.col("final")).otherwise(F.col("full")).alias("owed"))


class Mix:
    """``laid``: the rows in their source's stream; ``blocks``: those drawn; ``pieces``: a row for each part of a row that lies in one drawn block."""

    def __init__(self, docs: DataFrame, block_words: int | None = None, shard_blocks: int = SHARD_BLOCKS, rows: bool = False):
        folder = shared_dir(docs.sparkSession)
        sizes = cut(sized(docs, rows), folder, "sizes")
        total, n = sizes.agg(F.sum("size"), F.count("*")).first()
        block_words = block_words or max(BLOCK_WORDS, -(-CAP * (total or 0) // MOST_BLOCKS))
        self.sources = cut(block_size(targets(sizes), block_words), folder, "sources")
        self.laid = cut(laid(sizes, self.sources, n), folder, "laid")
        self.blocks = assigned(self.sources, shard_blocks)
        at = self.laid.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))))
        at = at.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("begin")).withColumn("hi", F.col("lo") + F.col("size"))
        at = at.withColumn("block", F.explode(F.sequence(F.expr("lo div block_words"), F.expr("(hi - 1) div block_words"))))
        began = F.col("block") * F.col("block_words")
        self.pieces = at.join(self.blocks.hint("shuffle_merge"), ["skey", "block"]).withColumn("taken", F.least(F.col("hi"), began + F.col("owed")) - F.greatest(F.col("lo"), began)).where("taken > 0")

    def documents(self) -> DataFrame:
        """What the mix takes of each row."""
        at = ["skey", "bucket", "rid"]
        taken = self.pieces.groupBy(*at).agg(F.sum("taken").alias("taken"))
        return self.laid.join(taken, at, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, once for each time they are taken.

    A document is taken whole where its first word is, so a source may exceed or
    miss its target by about a document for each run of blocks. Each shard is a
    partition in an order of its own.
    """
    mix = Mix(docs, rows=True)
    first = mix.pieces.where("lo div block_words = block").select(*PRINTS, F.col("shard").alias("_shard"), F.xxhash64(*PRINTS, "epoch", "bucket", "rid", F.lit(SEED)).alias("_order"))
    own = docs.withColumns(dict(zip(PRINTS, fingerprint(docs))))
    equal = mix.laid.groupBy(*PRINTS).count().where("count > 1").select(PRINTS[0])
    told = marked(own, PRINTS[0], equal)
    one = told.where("_in").groupBy(*PRINTS).agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*", *PRINTS)
    joined = told.where("not _in").drop("_in").unionByName(one).join(first, PRINTS)
    return joined.repartition("_shard").sortWithinPartitions("_shard", "_order").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents()
