"""The classifiers' features and learning against plain versions of them."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rillet.llm import quality, textscan, toxicity
from texts import TEXTS

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(raw):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)


# 8
def kind(b):
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\x0b\x0c\r", ".", ",;:", "!?", "#$%&*@^~", "|<>{}[]\\/=+_", "'\"()-")
    if b >= 0x80:
        return 12 if b < 0xC0 else 13
    found = [k for k, g in enumerate(groups) if chr(b) in g]
    return found[0] if found else 14 if b < 9 else 15


def plain_statistics(text):
    raw = text.encode()
    words, lines = WORD.findall(raw), re.findall(rb"[^\n]+", raw)
    n, size = len(words), len(raw)
    safe = lambda a, b: a / max(b, 1)
    small = [lower(w) for w in words]
    pairs = list(zip(small, small[1:]))
    most = lambda xs: max(collections.Counter(xs).values(), default=0)
    mean = safe(sum(map(len, words)), n)
    kinds = collections.Counter(map(kind, raw))
    return [
        *[safe(kinds[k], size) for k in range(16)], math.log1p(n), math.log1p(size), mean, math.sqrt(max(safe(sum(len(w) ** 2 for w in words), n) - mean**2, 0)),
        safe(len(set(small)), n), safe(most(small), n), safe(len(set(pairs)), n - 1), safe(most(pairs), n - 1), safe(sum(a == b for a, b in pairs), n - 1),
        safe(sum(kind(w[0]) == 1 for w in words), n), safe(sum(kind(w[-1]) in (8, 9) for w in words), n), safe(sum(len(w) > 20 for w in words), n), safe(sum(len(w) == 1 for w in words), n),
        len(lines), safe(size, len(lines)), safe(len({lower(x) for x in lines}), len(lines)), safe(sum(x[-1:] == b"." for x in lines), len(lines)),
    ]


def test_statistics_of_texts():
    got = quality.of_column(pa.array(TEXTS))
    for text, row in zip(TEXTS, got):
        assert row == pytest.approx(plain_statistics(text), abs=1e-9), text[:40]


def plain_tree(x, g, h, edges, depth, least):
    """One tree by trying every edge of every feature at every node; (feature, above, value) in heap order."""
    feature, above = [0] * (2**depth - 1), [math.inf] * (2**depth - 1)
    rows = {0: list(range(len(x)))}
    for node in range(2**depth - 1):
        mine, best = rows.get(node, []), (1e-6, 0, math.inf)
        total_g, total_h = sum(g[i] for i in mine), sum(h[i] for i in mine)
        for f in range(len(x[0])):
            for e in edges[f]:
                left = [i for i in mine if x[i][f] <= e]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl < least / 4 or total_h - hl < least / 4:
                    continue
                gain = gl**2 / (hl + quality.LAMBDA) + (total_g - gl) ** 2 / (total_h - hl + quality.LAMBDA) - total_g**2 / (total_h + quality.LAMBDA)
                if gain > best[0] + 1e-12:
                    best = (gain, f, e)
        feature[node], above[node] = best[1:]
        for i in mine:
            rows.setdefault(2 * node + 1 + (x[i][best[1]] > best[2]), []).append(i)
    value = []
    for leaf in range(2**depth - 1, 2 ** (depth + 1) - 1):
        mine = rows.get(leaf, [])
        value.append(-quality.RATE * sum(g[i] for i in mine) / (sum(h[i] for i in mine) + quality.LAMBDA))
    return feature, above, value


def test_boosting_by_hand(monkeypatch):
    for name, v in (("TREES", 3), ("DEPTH", 3), ("BINS", 16), ("LEAST", 2.0)):
        monkeypatch.setattr(quality, name, v)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] * x[:, 0] > 0.5)).astype(float)
    model = quality.boost(x, y)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
    raw = [math.log(y.mean() / (1 - y.mean()))] * len(x)
    assert model.bias == pytest.approx(raw[0])
    for t in range(3):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        feature, above, value = plain_tree(x.tolist(), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], edges, 3, 2.0)
        assert model.feature[t].tolist() == feature and model.above[t].tolist() == above and model.value[t].tolist() == pytest.approx(value)
        for i in range(len(x)):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (x[i][feature[node]] > above[node])
            raw[i] += value[node - 7]
    assert model.scores(x) == pytest.approx([1 / (1 + math.exp(-r)) for r in raw])


# 9
def plain_grams(text):
    """What a text's features stand for, in the order of their kinds, with how often each is there."""
    words = ALNUM.findall(lower(text.encode()))
    out = [[("w", w) for w in words]]
    out += [[("stem", size, w[:size]) for w in words if len(w) > size] for size in toxicity.STEMS]
    out += [[("pair", gap, a, b) for a, b in zip(words, words[gap:])] for gap in (1, 2)]
    return out


def test_features_of_texts():
    """Each word, stem, pair and skip-gram has one place of its own, in the row where it is; repeats have another."""
    place, used = {}, collections.Counter()
    for text in TEXTS:
        words = textscan.Words(*textscan.buffers(pa.array([text])), textscan.ALNUM)
        want = set()
        for named, (row, at, counted) in zip(plain_grams(text), toxicity.grams(words), strict=True):
            assert len(named) == len(at) and not row.any()
            for name, p in zip(named, at.tolist()):
                assert place.setdefault(name, p) == p
            want.update(at.tolist())
            if counted:
                want.update(int(toxicity.AGAIN[place[name]]) for name, n in collections.Counter(named).items() if n >= toxicity.REPEATS)
        assert set(toxicity.keys(words).tolist()) == want
    used.update(place.values())
    assert sum(n > 1 for n in used.values()) < 0.02 * len(place)


def plain_ftrl(rows, labels):
    """Per coordinate, in dicts, as the method is published; the intercept has no penalty."""
    z, n, none = collections.defaultdict(float), collections.defaultdict(float), "bias"

    def weight(i):
        penalty = 0 if i == none else toxicity.L1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    rng = np.random.default_rng(7)
    for _ in range(toxicity.ROUNDS):
        for k in rng.permutation(len(rows)):
            at = [*rows[k], none]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - labels[k]
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: w for i in z if (w := weight(i)) and i != none}, weight(none)


def test_ftrl_by_hand():
    rng = random.Random(9)
    rows = [sorted(rng.sample(range(300), 12)) for _ in range(150)]
    labels = [int(any(i < 25 for i in r) and rng.random() < 0.9) for r in rows]
    model = toxicity.ftrl([np.array(r, np.int32) for r in rows], np.array(labels))
    weights, bias = plain_ftrl(rows, labels)
    assert model.bias == pytest.approx(bias) and set(model.places.tolist()) == set(weights) and 5 < len(weights) < 200
    assert [weights[i] for i in model.places.tolist()] == pytest.approx(model.weights.tolist(), abs=1e-5)


def scores_of(query, spark, column, parts, part):
    labels = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.doc_id is not None and r[column] is not None}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in query(spark, "/root/testdata/sf0.01").where("held_out").collect() if r.doc_id in labels]
    good, bad = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    return auc, np.mean([p == y for _, y, p in rows])


def test_held_out_accuracy(spark):
    """On labels that no fit has seen."""
    auc, accuracy = scores_of(quality.query, spark, "quality", 4, 2)
    assert auc > 0.97 and accuracy > 0.93, (auc, accuracy)
    auc, accuracy = scores_of(toxicity.query, spark, "toxic", 3, 1)
    assert auc > 0.9 and accuracy > 0.93, (auc, accuracy)
