"""Operators on texts against brute force, on edge cases and on the smallest table."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rillet.llm import common, exact_dedup, licenses, pieces, quality, textscan, token_shards, toxicity
from rillet.scratch import shared_dir

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def collected(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# words
def test_words():
    column = pa.array(["a Bc", None, "", " x ", "b", "c"])
    data, offsets = textscan.buffers(column)
    w = textscan.Words(data, offsets, textscan.NOT_SPACE)
    assert w.rows().tolist() == [0, 0, 3, 4, 5] and w.pairs().tolist() == [0] and w.pairs(2).tolist() == []
    h = w.hashes()
    assert h[1] == textscan.Words(*textscan.buffers(pa.array(["zz bC"])), textscan.NOT_SPACE).hashes()[1] != h[0]
    assert [(i, j) for i, j, *_ in textscan.pieces(data, offsets, 3)] == [(0, 1), (1, 4), (4, 6)]


# 1
def test_pieces(edges, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (edges, docs):
        want = sorted((i, len(ids := library.encode(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True) for i, t in collected(df) if i is not None)
        assert sorted(tuple(r) for r in pieces.digests(df, PIECES).where("doc_id is not null").collect()) == want


def test_spans(spark, edges, nothing):
    out = pieces.encode(edges, PIECES)
    assert out.columns == edges.columns
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in out.collect():
        raw = (r.text or "").encode()
        assert [p.id for p in r.pieces] == library.encode(r.text or "")
        assert b"".join(raw[p.begin : p.end] for p in r.pieces) == raw
    assert pieces.encode(nothing, PIECES).count() == 0 == pieces.digests(nothing, PIECES).count()
    ids = spark.createDataFrame([([1724, 338],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(ids, PIECES).collect()] == [library.decode([1724, 338]), "", ""]


def test_covered():
    """Told for many texts at once as by their spans, and false where a piece is missing."""
    code = pieces.encoder(PIECES)
    raw = [(t or "").encode() for t in ["", " ▁▁  x ", "\n\n é ", "the quick  brown fox", "漢字 😀", " "]]
    ids = [x for x, _ in code.encode([r.decode() for r in raw])]
    assert code.covered(raw, ids) == [True] * len(raw) and code.covered([], []) == []
    assert code.covered(raw, [x[:-1] for x in ids])[1:] == [False] * (len(raw) - 1)
    for r, x in zip(raw, ids):
        begin, end = code.spans(r, x)
        assert not len(x) or (begin[0] == 0 and end[-1] == len(r) and (begin[1:] == end[:-1]).all())


def odd_texts(n, seed=6):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "the", "▁", "é", "e\u0301", "\t", "漢", "😀", "ꙮ", "🧿", "ﬁ", "㍿", "½", "ｶﾞ", "<s>", "\0", "\x01", "x1"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


def test_spans_of_library():
    """Each piece has the span that the library gives it, also where several pieces are the bytes of one character."""
    code, texts = pieces.Encoder(PIECES), odd_texts(2000)
    raw, ids = [t.encode() for t in texts], [x for x, _ in code.encode(texts)]
    want = [(p.begin, p.end) for r in raw for p in code.library.encode(r, return_type="proto").pieces]
    assert [span for r, x in zip(raw, ids) for span in zip(*(v.tolist() for v in code.spans(r, x)))] == want


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc"])
def test_spans_of_compiled_map(rule, tmp_path):
    """The same for models with and without a map, in windows of any size."""
    texts = odd_texts(600, 8)
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter([t for t in texts if "\0" not in t] * 3), model_prefix=str(tmp_path / "m"), vocab_size=400, model_type="bpe", byte_fallback=True, normalization_rule_name=rule, remove_extra_whitespaces=False, hard_vocab_limit=False, minloglevel=2
    )
    code = pieces.Encoder(str(tmp_path / "m.model"))
    assert bool(len(code.normal.units)) == (rule != "identity")
    raw, ids = [t.encode() for t in texts], code.library.encode(texts)
    want = [(p.begin, p.end) for r in raw for p in code.library.encode(r, return_type="proto").pieces]
    assert [span for r, x in zip(raw, ids) for span in zip(*(v.tolist() for v in code.spans(r, x)))] == want
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = list(code.normal.forms(data, bounds, True))
    for size in (1, 7, 100):
        parts = list(code.normal.forms(data, bounds, True, size))
        assert len(parts) > 1 and all((np.concatenate([p[k] for p in parts]) == np.concatenate([p[k] for p in whole])).all() for k in (1, 2))


def test_digests_make_spans(docs, monkeypatch):
    """``covered`` is told from the spans of all pieces over the normal form, which the map gives."""
    code, made = pieces.encoder(PIECES), []
    forms = pieces.Normalizer.forms

    def noted(self, data, bounds, *more):
        made.append(data.tobytes())
        return forms(self, data, bounds, *more)

    monkeypatch.setattr(pieces.Normalizer, "forms", noted)
    raw = [r.text.encode() for r in docs.where("text is not null").limit(20).collect()]
    ids = [x for x, _ in code.encode([r.decode() for r in raw])]
    assert code.covered(raw, ids) == [True] * len(raw) and made == [b"".join(raw)]
    begin, end, tiled = code.project(raw, ids)
    assert list(zip(begin.tolist(), end.tolist())) == [(p.begin, p.end) for r in raw for p in code.library.encode(r, return_type="proto").pieces] and tiled.all()
    assert code.covered(raw, [*ids[:-1], ids[-1][:-1]]) == [*[True] * (len(raw) - 1), False]


def test_remembered_parts(monkeypatch):
    """No batch brings more than the bound, long parts aren't remembered, and what is takes little; ids stay the library's."""
    code, rng = pieces.Encoder(PIECES), random.Random(9)
    words = list({"".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(20000)})
    tracemalloc.start()
    code.encode([" ".join(words)])
    took = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(code.words) == len(words) and took < 250 * len(words)
    monkeypatch.setattr(pieces, "WORDS", 50)
    code = pieces.Encoder(PIECES)
    texts = [" ".join(words[:200]), " ".join([*words[150:300], "z" * 5000])]
    assert [x for x, _ in code.encode(texts)] == code.library.encode(texts) and len(code.words) == 50
    monkeypatch.setattr(pieces, "WORDS", 5000)
    assert [x for x, _ in code.encode(texts)] == code.library.encode(texts) and len(code.words) == 300


def test_memory_is_given_back(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    run = common.lean(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2]))) == [2, 4] and done == [1]
    next(part := run(iter([1, 2]))), part.close()
    assert done == [1, 1]


def test_borders():
    code, rng = pieces.encoder(PIECES), random.Random(5)
    parts = [" ", "  ", "\n", "a", "the", "▁", "é", "\t", "漢", "😀", "<s>", "\0", "x1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(5000)]
    for t, (ids, text), want in zip(texts, code.encode(texts), code.library.encode(texts)):
        assert ids == want and text == ",".join(map(str, want)), t


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_map(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normalizer.of_model(library.serialized_model_proto())
    for t in ["ﬁ ½ Ａｂ  ㍿  x", "á b ", "  hello ", "ＡＢＣ\t12", "é", "", "Ⅷ ｶﾞ"]:
        body, places = own(t.encode())
        assert body.decode() == library.normalize(t) and len(places) == len(body) + 1
        assert (np.diff(places) >= 0).all() and places[-1] <= len(t.encode())


# 3
def test_exact_dedup(edges, docs, nothing):
    for df in (edges, docs):
        groups = {}
        rows = collected(df)
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
        for i, t in rows:
            groups.setdefault(norm(t), []).append(i)
        least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        want = [(i, least[norm(t)], len(groups[norm(t)]), i is not None and i == least[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in exact_dedup.classes(df).collect())
        kept = exact_dedup.keep(df)
        assert kept.columns == df.columns
        stays = {(w[0], norm(t)) for w, (_, t) in zip(want, rows) if w[3]}
        assert sorted(str((r.doc_id, norm(r.text or ""))) for r in kept.collect()) == sorted([*map(str, stays), *[str((None, norm(t))) for i, t in rows if i is None]])
    assert exact_dedup.classes(nothing).count() == 0 == exact_dedup.keep(nothing).count()


def test_exact_keep_by_rows(spark):
    """A row goes for its own text; rows of one id and text give one, and other rows of the id don't matter."""
    rows = [(1, "a", 1), (2, "b", 2), (2, "a", 3), (3, "c", 4), (3, "c ", 5), (3, "c", 4), (4, "c", 6), (5, "b", 7), (5, "d", 8), (None, "a", 9)]
    df = spark.createDataFrame([(i, t, k, {"k": str(k)}) for i, t, k in rows], "doc_id long, text string, kept int, _h map<string,string>").repartition(3)
    got = exact_dedup.keep(df)
    assert got.columns == df.columns
    found = sorted((str(r.doc_id), r.text) for r in got.collect())
    assert found == sorted([("1", "a"), ("2", "b"), ("3", "c"), ("3", "c "), ("5", "d"), ("None", "a")])
    long = spark.createDataFrame([(1, "x" * 2_000_000), (2, "x" * 2_000_000), (3, "x" * 1_999_999 + "y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.classes(long).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_hot_groups(spark, monkeypatch):
    """A group over the broadcast threshold, and others, give the same rows."""
    monkeypatch.setattr("rillet.llm.common.HOT", 3)
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i % 4}") for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.classes(df).collect()}
    assert len(got) == 60 and got[1] == got[59] == (1, 40) and got[0] == (0, 5)


# 4
def test_licenses(edges, docs, nothing):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for df in (edges, docs):
        want = []
        for i, t in collected(df):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
            labels, best = {label for _, label in hits}, 1.0 if hits else 0.0
            for label, text in licenses.TEMPLATES:
                half = 48
                while half < len(text.split()):
                    half *= 2
                for b in range(0, max(len(w), 1), half):
                    if b and b + half >= len(w):
                        break
                    share = len(set(w[b : b + 2 * half]) & set(text.split())) / len(set(text.split()))
                    if share >= licenses.THRESHOLD - 1e-9:
                        labels.add(label)
                        best = max(best, share)
            places = [k for k, _ in hits]
            want.append((i, len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), best))
        got = licenses.scan(df, licenses.Scanner(licenses.frequencies(df))).drop("blocks")
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert licenses.scan(nothing, licenses.Scanner(licenses.frequencies(nothing))).count() == 0


def test_license_filters_lose_nothing():
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(30)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randint(2, 8)))) for k in range(12)]
    scanner = licenses.Scanner({}, templates, 0.7, 16)
    for _ in range(200):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        h = licenses.hashes(" ".join(words)) if words else np.empty(0, np.uint64)
        got = {(b, k) for _, b, _, k, _ in scanner.matches(h, np.array([0, len(words)]))}
        want = {(b, k) for b in range(0, len(words), 8) if not b or b + 8 < len(words) for k, t in templates if len(set(t.split()) & set(words[b : b + 16])) >= 0.7 * len(set(t.split())) - 1e-9}
        assert got == want


def test_whole_licences(spark):
    """Templates longer than half a usual block are found whole, in a long text and with some words changed."""
    filler = " ".join(f"f{k}" for k in range(5000))
    rows = [(1, licenses.MIT), (2, f"{filler} {licenses.MIT.upper()} {filler}"), (3, " ".join("zzz" if k % 9 == 0 else w for k, w in enumerate(licenses.BSD2.split()))), (4, filler), (5, " ".join(licenses.MIT.split()[:60]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(df, licenses.Scanner(licenses.frequencies(df))).collect()}
    assert "mit-full" in got[1] & got[2] and "bsd-full" in got[3] and got[4] == {""} and "mit-full" not in got[5]
    alone = licenses.Scanner({}, [("mine", licenses.MIT)])
    assert [m[3] for m in alone.matches(licenses.hashes(licenses.MIT), np.array([0, len(licenses.MIT.split())]))] == ["mine"]
    huge = " ".join(f"t{k}" for k in range(3000))
    assert licenses.Scanner({}, [("huge", huge)]).matches(licenses.hashes(f"{filler} {huge}"), np.array([0, 8000]))
    with pytest.raises(ValueError, match="no words"):
        licenses.Scanner({}, [("none", "...")])


# 8, 9
def labelled(spark, n=240):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        words = [rng.choice("lorem ipsum dolor sit amet elit sed do magna aliqua".split()) + rng.choice(["", "um", "is"]) for _ in range(rng.randint(20, 60))]
        toxic, bad = i % 3 == 0, i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "nastyish"]))
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(n + 5, 1, 1), (None, 1, 1), (3, None, None), (labels[0][0], 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def split_of(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


def test_toxicity(spark, edges, nothing):
    df, labels = labelled(spark)
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    held = [i for i in got if split_of(i, 3, 1)]
    assert np.mean([(got[i] >= 0.7) == (i % 3 == 0) for i in held]) >= 0.95
    again = toxicity.fit(df.repartition(5), labels)
    assert np.array_equal(again.places, model.places) and again.bias == model.bias
    out = toxicity.scored(edges, model)
    assert set(out.columns) == set(edges.columns)
    scores = {r.doc_id: r.score for r in out.collect()}
    assert scores[0] == scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.scored(nothing, model).count() == 0
    assert toxicity.fit(df, labels.where("false")).bias == 0.0 and len(toxicity.fit(nothing, labels).places) == 0


def test_toxicity_scores_by_hand(spark):
    df, labels = labelled(spark, 60)
    model = toxicity.fit(df, labels)
    weight = dict(zip(model.places.tolist(), model.weights.tolist()))
    for r in toxicity.scored(df, model).limit(10).collect():
        words = textscan.Words(*textscan.buffers(pa.array([r.text])), textscan.ALNUM)
        found = {int(p) for p in toxicity.keys(words) & ((1 << toxicity.BITS) - 1)}
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(weight.get(p, 0) for p in found)))), abs=1e-6)


def test_quality(spark, edges, nothing):
    df, labels = labelled(spark)
    model = quality.fit(df, labels)
    x = quality.of_column(pa.array([r.text for r in df.orderBy("doc_id").collect()]))
    got = model.scores(x)
    held = [i for i in range(240) if split_of(i, 4, 2)]
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in held]) >= 0.95
    walked = []
    for row in x[:20]:
        total = model.bias
        for f, a, v in zip(model.feature, model.above, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + bool(row[f[node]] > a[node])
            total += v[node - len(f)]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walked, got[:20])
    odd = quality.of_column(pa.array([r.text for r in edges.collect()]))
    assert np.isfinite(odd).all() and not odd[0].any() and not odd[1].any()
    assert quality.of_column(pa.array([], pa.string())).shape == (0, quality.FEATURES)
    assert (quality.fit(df, labels.where("false")).scores(x) == 0.5).all() and quality.fit(nothing, labels).bias == 0.0


def test_statistics():
    x = quality.statistics(*textscan.buffers(pa.array(["ab ab cd", "X!\nX!"])))
    assert x[0][16:25] == pytest.approx([np.log(4), np.log(9), 2, 0, 2 / 3, 2 / 3, 1, 0.5, 0.5])
    assert x[1][29] == 2 and x[1][31] == 0.5


def test_classifier_queries(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for query, parts, part in ((quality.query, 4, 2), (toxicity.query, 3, 1)):
        rows = query(spark, sf).collect()
        assert len(rows) == n
        for r in rows:
            assert r.held_out == split_of(r.doc_id, parts, part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


# 10
def test_token_shards(spark, edges, docs, nothing):
    library = Tokenizer.from_file(WORDS)
    for df, size in ((edges, 2000), (docs, 20_000)):
        manifest = token_shards.write(df, shared_dir(spark), WORDS, 2, size)
        got = sorted((tuple(r) for r in token_shards.read(manifest).collect()), key=lambda r: r[1])
        rows = sorted(collected(df), key=lambda r: (r[0] is not None, r[0] or 0))
        start, want = 0, []
        for i, t in rows:
            ids = [*library.encode(t, add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    empty = token_shards.write(nothing, shared_dir(spark), WORDS, 2)
    assert empty.count() == 0 == token_shards.read(empty).count()


def test_shard_access(spark, docs, monkeypatch):
    path = token_shards.write(docs.limit(50), shared_dir(spark), WORDS, 2).first().path
    shard = token_shards.Shard(path)
    assert len(shard) > 0 and shard[3][-1] == 2 and len(shard[3]) == shard.index["n"][3]
    for window in (1, 3000, 1 << 20):
        assert [x.tolist() for x in shard.documents(window)] == [shard[k].tolist() for k in range(len(shard))]

    class Watched:
        read = []

        def read_at(self, n, at):
            self.read.append(n)
            return shard_file.read_at(n, at)

    shard_file, shard.file = shard.file, Watched()
    assert shard[5][-1] == 2 and Watched.read == [int(shard.index["size"][5])]  # one frame, not the body
    broken = open(path.removeprefix("file://"), "rb").read()[:-1]
    cut = path.removeprefix("file://") + ".cut"
    open(cut, "wb").write(broken)
    with pytest.raises(ValueError):
        token_shards.Shard(cut)


def test_shards_of_one_id(spark):
    """Rows of one id are divided among tasks and shards, in the order that starts have."""
    rows = [(7, f"text number {i} " * (i % 9)) for i in range(300)] + [(3, "before"), (9, "after")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = token_shards.write(df, shared_dir(spark), WORDS, 2, 1500)
    found = manifest.collect()
    assert len({r.task for r in found}) > 1 and len(found) > 4 and sum(r.n_docs for r in found) == len(rows)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_shards.read(manifest).collect())
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(r[1:] for r in got) == sorted(want) and [r[1] for r in got] == sorted(r[1] for r in got)
    assert [r[0] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()


def test_dictionary_of_few_samples(spark, docs):
    """Too few documents to train on are the dictionary themselves."""
    few = token_shards.train(docs.limit(5), WORDS, 2)
    assert few and len(few) <= token_shards.DICTIONARY_BYTES and token_shards.train(docs.where("false"), WORDS, 2) == b""
    manifest = token_shards.write(docs.limit(5), shared_dir(spark), WORDS, 2)
    assert token_shards.read(manifest).count() == 5


def test_word_coder_limits(monkeypatch):
    monkeypatch.setattr(token_shards, "WORDS", 3)
    monkeypatch.setattr(token_shards, "PARTS", 3)
    code, library = token_shards.WordCoder(WORDS), Tokenizer.from_file(WORDS)
    texts = ["don't stop, 12 é's!", "Straße ΑΣ x\x1fy z w", "a_b c--d", "<|endoftext|>x", "'S 'rex"] * 2
    for t, raw in zip(texts, code.encode([t.encode() for t in texts])):
        assert np.frombuffer(raw, code.type).tolist() == library.encode(t, add_special_tokens=False).ids
