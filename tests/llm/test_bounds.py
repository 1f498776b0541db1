"""What bounds of samples and sizes must not change."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rillet.llm import near_dedup, quality, textscan, token_shards, topk, toxicity


# 9
def test_toxicity_share(spark):
    """The share that scores hold for is the labels', whether or not the bound of a class bites."""
    ids = range(1500)
    df = spark.createDataFrame([(i, "...") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in ids], "doc_id long, toxic int")
    for rows in (toxicity.ROWS, 200, 50):
        model = toxicity.fit(df, labels, rows=rows)
        scores = [r.score for r in toxicity.scored(df.limit(1), model).collect()]
        assert abs(np.mean(scores) - 0.1) < 0.05, rows
    assert toxicity.correction({0: 9000, 1: 1000}, {0: 90, 1: 10}) == 0.0 == toxicity.correction({0: 9000}, {0: 10})
    assert np.isclose(toxicity.correction({0: 9000, 1: 1000}, {0: 500, 1: 500}), np.log(1 / 9))
    few = toxicity.fit(df, labels, features=0)  # one document, whatever its length
    assert few.bias == 0.0 or not len(few.places)


# 8, 9
def test_repeated_documents_teach_once(spark, monkeypatch):
    """A doc_id that holds most rows brings one row to the driver, the same in any order of rows."""
    rows = [(i, f"plain words number {i}") for i in range(60)] + [(0, f"another text {k % 50}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    taught = []
    def learnt(docs):
        rows = toxicity.samples(docs, labels)[0].collect()
        taught.append([len(rows), sorted(bytes(r.places) for r in rows)])

    monkeypatch.setattr(quality, "boost", lambda x, y: taught.append([len(x), sorted(r.tobytes() for r in x)]))
    for module, fit in ((toxicity, learnt), (quality, lambda docs: quality.fit(docs, labels))):
        fit(df), fit(df.repartition(7))
        first, again = taught[-2:]
        assert first[0] == labels.where(~module.held_out("doc_id", *((3, 1) if module is toxicity else (4, 2)))).count()
        assert first == again


# 6
def test_estimates_of_small_sets():
    """Pairs right at the threshold are likely, though registers of small sets are few and borrowed."""
    rng = np.random.default_rng(1)
    n = np.array([36, 45])
    for seed in range(4000):
        a = rng.integers(0, 1 << 64, 45, np.uint64)
        regs = np.array([near_dedup.registers(np.sort(a[:36])), near_dedup.registers(np.sort(a))])
        assert near_dedup.likely(regs, n)[0, 1], seed
    # 79 of 128 registers match: an estimate of 0.617, which pairs at 0.8 do have
    regs = np.arange(256, dtype=np.uint16).reshape(2, 128)
    regs[1, :79] = regs[0, :79]
    for size in (33, 36, 45, 90, 500):
        assert near_dedup.likely(regs, np.array([size, size]))[0, 1], size
    regs[1, 60:79] += 128
    assert not near_dedup.likely(regs, np.array([500, 500]))[0, 1]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomials_confuse(spark):
    """Long words of equal polynomial hashes in every base modulo 2**64 are different words."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    w = textscan.Words(*textscan.buffers(pa.array([f"{one} {two} {one.upper()}"])), textscan.NOT_SPACE)
    assert w.hashes()[0] == w.hashes()[1] and w.firm()[0] != w.firm()[1] and w.firm()[0] == w.firm()[2]
    got = near_dedup.classes(spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {1: (1, True), 2: (2, True), 3: (1, False)}


def counted(spark, monkeypatch, rows, limit=near_dedup.LIMIT):
    """The components of ``rows``, and the number of pairs verified before and after the exact join."""
    made, cut = {}, near_dedup.cut

    def count(df, folder, name):
        out = cut(df, folder, name)
        made[name] = out.select("a", "b").distinct().count() if {"a", "b"} <= set(out.columns) else out.count()
        return out

    monkeypatch.setattr(near_dedup, "cut", count)
    got = {r.doc_id: r.component_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limit).collect()}
    monkeypatch.setattr(near_dedup, "cut", cut)
    return got, made.get("first", 0), made.get("second", 0)


@pytest.mark.parametrize("limit", [near_dedup.LIMIT, 100])
def test_boilerplate_is_linear(spark, monkeypatch, limit):
    """Many texts that share most of their words, but are no links, propose about as many pairs as they are."""
    for n in (200, 400) if limit == near_dedup.LIMIT else (300,):
        rng = random.Random(n)
        short = [(i, f"please now do click here x{i}") for i in range(n)]
        common = " ".join(f"c{k}" for k in range(170))
        long = [(n + i, common + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(34))) for i in range(n)]
        got, first, second = counted(spark, monkeypatch, short + long, limit)
        assert all(i == c for i, c in got.items())
        assert first <= 32 * 2 * n * (1 if limit > n else 1.5) and second <= n // 10, (n, first, second)


def test_large_groups_of_copies(spark, monkeypatch):
    """Copies of one text in a divided bucket are linked through its delegates; pairs verified are far fewer than all."""
    rng, n = random.Random(3), 600
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        mine = list(words)
        for _ in range(2):
            mine[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(mine)))
    got, first, second = counted(spark, monkeypatch, rows, 50)
    assert set(got.values()) == {0} and first + second < n * (n - 1) / 2 / 4


# 2
def test_vectors_of_every_dimension(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    want = []
    for q in range(0, 120, topk.EVERY):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored[: topk.TOP], 1)]
    assert sorted(map(tuple, topk.query(spark, str(tmp_path)).collect())) == want


# 10
def test_dictionary_is_the_same_in_any_order(spark, monkeypatch):
    """Where more documents are chosen than the sample holds, which ones train doesn't depend on the order of rows."""
    monkeypatch.setattr(token_shards, "SAMPLE", 100)
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, 6, np.uint8)).decode() for _ in range(300)]
    rows = [(5, " ".join(rng.choice(words, 60))) for _ in range(1500)]  # one id, so all or none are chosen
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_shards, "round", lambda x: 1 << 30, raising=False)
    made = [token_shards.train(spark.createDataFrame(r, "doc_id long, text string"), path, 0) for r in (rows, rows[::-1])]
    assert made[0] == made[1] != b""
