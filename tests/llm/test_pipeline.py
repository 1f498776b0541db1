"""The pipeline's stages against brute force, each on its own input."""

import collections
import hashlib
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from rillet.llm import toxicity
from rillet.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, docs.schema)
        got = stage(spark, docs, SF)
        out[name] = got
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [r[:-1] for r in map(tuple, toxicity.scored(docs, model).collect()) if r[-1] < 0.7]
        elif name == "exact_dedup":
            first = {}
            for r in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
            want = list(first.values())
        elif name == "near_dedup":
            from test_group_operators import brute_components

            roots = brute_components([r[:2] for r in rows])
            want = [r for r in rows if roots[r[0]] == r[0]]
        elif name == "mixing":
            took = [tuple(r) for r in got.collect()]
            assert set(took) <= set(rows) and max(collections.Counter(took).values()) <= 2
            from test_group_operators import brute_targets, words_of

            sizes, given, longest = collections.Counter(), collections.Counter(), collections.Counter()
            for r in rows:
                sizes[r[3]] += words_of(r[1])
                longest[r[3]] = max(longest[r[3]], words_of(r[1]))
            for r in took:
                given[r[3]] += words_of(r[1])
            target = brute_targets(sizes)
            # a document is taken where its first word is: one at each end of a run is more or less
            assert all(abs(given[s] - target[s]) <= 2 * longest[s] for s in sizes), {s: (given[s], target[s], longest[s]) for s in sizes}
            rows = took
            continue
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = sorted((r[0], len(ids := library.encode(r[1])), hashlib.sha256(library.decode(ids).encode()).hexdigest()) for r in rows)
            assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.collect()) == want
            continue
        assert got.columns == columns
        assert sorted(map(tuple, got.collect())) == sorted(want)
        rows = want


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(oracle_sql()) <= set(queries()) and corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.where("not covered").isEmpty()


def test_odd_documents(spark, edges, nothing):
    """Null ids and texts, repeated ids of other texts, more columns and empty tables go through every stage."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    twice = edges.unionByName(edges.where("doc_id in (4, 9)").withColumn("text", edges.text.substr(1, 4)))
    rows = {(r.doc_id, r.text) for r in twice.collect()}
    for name, stage in corpus_pipeline.STAGES:
        empty, out = stage(spark, nothing, SF), stage(spark, twice, SF)
        assert empty.count() == 0
        if name == "pieces":
            assert out.count() == twice.count() and {"doc_id", "source"} <= set(out.columns)
            continue
        assert out.columns == empty.columns == columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert set(got) <= rows
        if name == "exact_dedup":
            # rows of one id stay or go by their own text
            assert len({" ".join((t or "").split()) for i, t in got if i == 4}) == len([1 for i, _ in got if i == 4]) and (9, "▁▁ <") in got
