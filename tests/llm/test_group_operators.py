"""Operators across rows against brute force, with hot groups, ties and empty tables."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from rillet.llm import components, mixing, near_dedup, topk, warc
from rillet.scratch import shared_dir


# 2
def brute_top(rows, queries, k):
    rows = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows]
    out = []
    for q in queries:
        vector = min((v.tolist() for i, v in rows if i == q))
        found = sorted((-int(np.dot(vector, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("n, dim, cell", [(300, 4, 32), (15, 3, 64), (200, 8, 7)])
def test_topk(spark, n, dim, cell):
    rng = random.Random(n)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(n // 3)]  # a third lies at one place
    rows += [(rows[7][0], rows[9][1])]
    odd = [(5000, None), (5020, [None] * dim), (5040, [float("nan")] * dim), (5060, [float("inf")] * dim), (None, [1.0] * dim), (5080, [1.0] * (dim + 1))]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cell string").repartition(3)
    vectors = topk.quantised(df).cache()
    index = topk.Index(vectors, shared_dir(spark), cell)
    got = index.top(vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 20)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, sorted({i for i, _ in rows if i % 20 == 0}), 20)
    assert index.rows.count() == len(rows)


def exact_top(rows, queries, k):
    """By Python's integers of any size."""
    whole = [(i, [int(x) * 64 if abs(x) >= 2**53 else int(np.floor(64 * x)) for x in v]) for i, v in rows]
    out = []
    for q, vector in whole:
        if q in queries:
            found = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q)[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("size", [1e6, 2.0**24, 2.0**30, 1e200])
def test_topk_of_large_components(spark, size):
    """Scores beyond what doubles or longs hold are ranked as integers of any size."""
    rng = random.Random(5)
    rows = [(i, [float(round(rng.uniform(0.5, 1) * size)) for _ in range(3)]) for i in range(90)]
    rows += [(100 + i, [x + (i % 3) / 64 if size < 2**40 else x for x in rows[i][1]]) for i in range(30)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = topk.Index(df, shared_dir(spark), 16).top(df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 7)
    assert sorted(tuple(r) for r in got.collect()) == exact_top(rows, {i for i, _ in rows if i % 20 == 0}, 7)


def test_topk_leaves_cells_out(spark):
    """Where vectors lie in clusters, queries visit few parts, and parts keep their size in hot cells."""
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 1, (40, 4))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    rows = [(i, (centre[i % 40 if i % 3 else 7] + rng.normal(0, 0.01, 4)).tolist()) for i in range(4000)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).cache()
    index = topk.Index(df, shared_dir(spark), 64)
    got = index.top(df.where("vec_id % 200 = 0").withColumnRenamed("vec_id", "query_id"), 5, measure=True)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, {i for i, _ in rows if i % 200 == 0}, 5)
    assert index.share < 0.4, index.share
    sizes = [r["count"] for r in index.rows.groupBy("cell", "part").count().collect()]
    assert max(sizes) < 160 and len(index.cells.pivot) <= topk.PIVOTS * topk.STEPS


def test_topk_empty(spark):
    df = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.Index(df, shared_dir(spark)).top(df.withColumnRenamed("vec_id", "query_id")).count() == 0
    one = topk.quantised(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert topk.Index(one, shared_dir(spark)).top(one.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_topk_bounds():
    """Annuli are left out only where they can't serve: an early stop gives what a full scan gives."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 30, (2000, 3)))
    most = float((x * x).sum(1).max())
    pivot = topk.lifted(x[:1], most)
    radius = topk.distances(topk.lifted(x, most), pivot)[:, 0]
    order = radius.argsort()
    q = np.floor(rng.normal(0, 30, (40, 3)))
    near = topk.distances(np.column_stack([q, np.zeros(40)]), pivot)[:, 0]
    product = topk.Product(1.0, 3)  # of the scale 2**1
    scale = product.shift // 2
    a, b, s = topk.search(product, np.arange(40) + 10_000, q, near / 2**scale, np.full(40, -np.inf), order, x[order], radius[order] / 2**scale, most / 4**scale, 5)
    scores = q @ x.T
    want = [(10_000 + i, int(j), int(scores[i, j])) for i in range(40) for j in np.lexsort((np.arange(2000), -scores[i]))[:5]]
    assert sorted(zip(a.tolist(), b.tolist(), s.tolist())) == sorted(want)


# 5
@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


def brute_targets(sizes):
    """target of each source: shares by weight, whatever exceeds its bound fixed there, until none does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, left = {}, 1.5 * sum(sizes.values())
    todo = set(names)
    while todo:
        total = sum(weight[s] for s in todo)
        full = {s for s in todo if weight[s] * left / total >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * left / total for s in todo}
        out |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        todo -= full
    return out


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(spark, edges, docs, nothing):
    for df, block, shard in ((edges, 64, 3), (docs, 64, 5), (docs, 300, 2)):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        sizes = collections.Counter()
        for _, t, s in rows:
            sizes[s] += words_of(t)
        target = brute_targets(sizes)
        mix = mixing.Mix(df, block, shard)
        got = [tuple(r) for r in mix.documents().collect()]
        # every row, with its sizes and its source's target
        want = [(i, words_of(t), sizes[s]) for i, t, s in rows]
        assert sorted(str(r[:3]) for r in got) == sorted(map(str, want))
        near = {round(target[s]) for s in sizes}
        assert all(min(abs(r[3] - t) for t in near) <= 0.51 and 0 <= r[4] <= 2 * r[1] for r in got)
        laid = mix.laid.withColumn("s", mixing.F.col("skey")).collect()
        blocks = mix.blocks.collect()
        for key in {r.skey for r in laid}:
            own = sorted((r for r in laid if r.skey == key), key=lambda r: (r.begin, r.size))
            assert [r.begin for r in own] == np.cumsum([0, *[r.size for r in own]])[:-1].tolist()
            # the words drawn, by their place in the stream, against what each document is said to give
            drawn = set()
            for b in blocks:
                if b.skey == key:
                    places = range(b.block * own[0].block_words, b.block * own[0].block_words + b.owed)
                    assert drawn.isdisjoint(places)
                    drawn.update(places)
            name = None if key == "z" else key[1:]
            assert len(drawn) == int(np.floor(target[name] + 0.5))
            gives = sorted((r.doc_id or -1, r.size, sum((e * sizes[name] + p) in drawn for e in (0, 1) for p in range(r.begin, r.begin + r.size))) for r in own)
            said = [(r.doc_id or -1, r.size, r.taken) for r in mix.laid.join(mix.pieces.groupBy("skey", "bucket", "rid").agg(mixing.F.sum("taken").alias("taken")), ["skey", "bucket", "rid"], "left").na.fill(0, ["taken"]).where(mixing.F.col("skey") == key).collect()]
            assert gives == sorted(said)
        again = mixing.Mix(df.repartition(7), block, shard).documents()
        assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in again.collect())
    assert mixing.Mix(nothing).documents().count() == 0 == mixing.mixed(nothing).count()


def test_mixing_follows_the_tree(spark, docs, monkeypatch):
    """What documents give depends on how the tree divides blocks among shards, while sources' totals don't."""
    taken = lambda: {r.doc_id: r.taken for r in mixing.Mix(docs, 64, 3).documents().collect()}
    first, split = taken(), mixing.split
    monkeypatch.setattr(mixing, "split", lambda quotas, pools, shards: split(quotas, pools, 1))
    other = taken()
    assert first != other and sum(first.values()) == sum(other.values())


def test_mixed_rows(spark, docs, edges):
    """Every row comes as often as its own first word is drawn, whatever other rows have its id; equal rows together."""
    base = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()][:120]
    rows = base + [(base[0][0], "another text " * 30, "xx", base[1][3])] * 1 + [(base[2][0], base[2][1], "yy", base[2][3]), base[3], base[3], (None, "no id " * 20, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, taken int").repartition(3)
    mix = mixing.Mix(df, rows=True)
    chosen = collections.Counter()
    for r in mix.pieces.where("lo div block_words = block").select(*mixing.PRINTS).collect():
        chosen[tuple(r)] += 1
    prints = {tuple(r)[:5]: tuple(r)[5:] for r in df.select("*", *mixing.fingerprint(df)).collect()}
    want = collections.Counter({row: chosen[p] for row, p in prints.items() if chosen[p]})
    got = mixing.mixed(df)
    assert got.columns == df.columns and collections.Counter(tuple(r) for r in got.collect()) == want
    assert len(set(prints.values())) == len(set(rows))
    monkey = [(1, "x y z", "a"), (1, "x y z", "b")]
    small = spark.createDataFrame([(i, t, "en", s) for i, t, s in monkey], "doc_id long, text string, lang string, source string")
    assert {r.source for r in mixing.mixed(small).collect()} <= {"a", "b"}


def test_splitting_tree():
    quotas, pools = np.array([100, 1, 0, 37, 20]), np.array([150, 3, 5, 37, 400])
    shard, source, begin, count = mixing.split(quotas, pools, 7)
    per = np.bincount(source, count, 5)
    assert per.tolist() == quotas.tolist() and set(np.bincount(shard, count, 7).tolist()) <= {22, 23}
    for s in range(5):
        held = [p for b, c in zip(begin[source == s].tolist(), count[source == s].tolist()) for p in range(b, b + c)]
        assert len(set(held)) == len(held) == quotas[s] and all(0 <= p < pools[s] for p in held)
    assert all(np.array_equal(a, b) for a, b in zip((shard, source, begin, count), mixing.split(quotas, pools, 7)))
    assert [len(x) for x in mixing.split(np.zeros(3, int), np.ones(3, int), 2)] == [0, 0, 0, 0]


def test_mixing_many_sources(spark, monkeypatch):
    rows = [(i, "a b c d", f"s{i % 50}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.Mix(df, 4, 2).documents().collect()) == pytest.approx(1200, abs=50)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 40)
    with pytest.raises(ValueError, match="over 40 sources"):
        mixing.Mix(df)


def test_targets_cap(spark):
    rows = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 1000), ("z", 0)], "skey string, size long")
    got = {r.skey: r.target for r in mixing.targets(rows).collect()}
    assert got["sa"] == 20 and got["z"] == 0 and got["sc"] == 2 * got["sb"] and sum(got.values()) == pytest.approx(3015)


# 6
def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)]) if words else frozenset()


def brute_components(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            by[i].append(shingles(t))
    root = {i: i for i in by}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(by)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in by[a] for t in by[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_rows(seed, n=150):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 5, 11, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 3])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    return [*enumerate(rows), (None, rows[0]), (0, rows[5])]


@pytest.mark.parametrize("seed, limit", [(1, 1024), (2, 4), (3, 3)])
def test_near_dedup(spark, seed, limit):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    got = near_dedup.classes(df, limit).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)


def test_near_dedup_edges(edges, docs, nothing):
    for df in (edges, docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = brute_components(rows)
        got = near_dedup.classes(df).collect()
        assert sorted(str((r.doc_id, r.n_shingles)) for r in got) == sorted(str((i, len(shingles(t)))) for i, t in rows)
        assert all(r.component_id == want.get(r.doc_id) for r in got)
        kept = near_dedup.keep(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} - {None} == {i for i, c in want.items() if i == c}
    assert near_dedup.classes(nothing).count() == 0 == near_dedup.keep(nothing).count()


def test_registers():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3000], rng.integers(0, 2**64, 600, dtype=np.uint64)]))
    n = np.array([len(a), len(b)])
    true = 3000 / len(np.union1d(a, b))
    regs = np.array([near_dedup.registers(u) for u in (a, b)])
    chance = near_dedup.accidental(n)[0, 1]
    count = (regs[0] == regs[1]).mean()
    assert abs((count - chance) / (1 - chance) - true) < 0.15 and 0 < chance < 0.01
    assert (near_dedup.registers(a[:1]) == near_dedup.registers(a[:1])[0]).all()


def test_forest():
    w = np.array([[0, 5, 1, 0], [5, 0, 9, 0], [1, 9, 0, 0], [0, 0, 0, 0]])
    assert {tuple(sorted(e)) for e in near_dedup.forest(w)} == {(0, 1), (1, 2)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components.stars(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark), "c").collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 130)}}
    assert components.stars(spark.createDataFrame([], "a long, b long"), shared_dir(spark), "c").count() == 0


# 7
def warc_rows():
    inner = warc.record(5, "http://a", b"payload" * 300, hashlib.sha1(b"payload" * 300).hexdigest(), None).decode()
    big = "x" * 1500
    return [(1, "u", big), (2, None, big), (3, "u\r\nWARC/1.1", big + "y"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 600), (7, "u", "é" * 600), (8, "v", inner * 30), (9, "v", inner * 30), (10, "v", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 100), (11, "s", "short"), (12, "s", "short"), (2, None, big)]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("size", [100, 3000, 4 << 20])
def test_warc(spark, duck, compress, size):
    rows = warc_rows()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, sha1 string, first int").coalesce(1)
    folder = shared_dir(spark)
    got = warc.read(warc.write(df, folder, compress), folder, size).drop("path", "offset")
    duck.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert sorted(map(str, duck.sql(warc.SQL).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_warc_hot(spark, duck, monkeypatch):
    monkeypatch.setattr("rillet.llm.common.HOT", 4)
    rows = [(i, "u", ("h" * 1200 if i % 2 else f"{i % 6}" * 1100)) for i in range(40)]
    folder = shared_dir(spark)
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), folder).drop("path", "offset")
    duck.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert sorted(map(str, duck.sql(warc.SQL).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_warc_broken_and_empty(spark):
    folder = shared_dir(spark)
    archives = warc.write(spark.createDataFrame(warc_rows(), "page_id long, url string, html string").coalesce(1), folder)
    path = archives.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="no record at"):
        warc.read(archives, shared_dir(spark)).collect()
    none = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), shared_dir(spark))
    assert none.count() == 0 == warc.read(none, shared_dir(spark)).count()
    nulls = spark.createDataFrame([(None, None, "a" * 1001), (None, None, "a" * 1001), (3, None, "a" * 1001)], "page_id long, url string, html string")
    f = shared_dir(spark)
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read(warc.write(nulls, f), f).collect())
    assert got == [("3", "response", None), ("None", "revisit", 3), ("None", "revisit", 3)]
