import math
import random
import zlib

import numpy as np
import pytest

from barloom.llm import quality_model as q
from barloom.llm import toxicity as t

DOCS = "doc_id long, text string, score string, y string"
LABELS = "doc_id long, quality int, toxic int, text string"


def table(spark, n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = " ".join(rng.choice(words) + ("###" if bad else "") for _ in range(rng.randrange(30, 60)))
        docs.append((i, text + (" vilegrub" + " nastyword" * 2 if toxic else ""), "x", "y"))
        labels.append((i, int(not bad), int(toxic), "z"))
    extra = [(n, None, "x", None), (n + 1, "", None, None), (n + 2, "w" * 100_000, None, None), (0, docs[0][1], None, None), (None, "a b", None, None)]
    return spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame([*labels, (None, 1, 1, "z"), (3, None, None, "z")], LABELS)


@pytest.mark.parametrize("module, column, modulus, held, cut", [(q, "quality", 3, 1, 0.5), (t, "toxic", 4, 2, 0.3)])
def test_held_out(spark, module, column, modulus, held, cut):
    docs, labels = table(spark)
    got = module.query(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)
    truth = {r["doc_id"]: r[column] for r in labels.collect() if r[column] is not None}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    assert sorted(map(tuple, module.query(docs, labels).collect()), key=str) == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("module", [q, t])
def test_empty(spark, module):
    docs, labels = table(spark, 20)
    assert module.query(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in module.query(docs, labels.limit(0)).collect()} == {0.5 if module is q else 0.0}


def test_keep_clean_keeps_columns(spark):
    docs, labels = table(spark)
    left = t.keep_clean(docs, t.fit(docs, labels))
    assert left.columns == docs.columns and not any("vilegrub" in (r["text"] or "") for r in left.collect()) and left.count() >= 320


def test_pairs_by_squares():
    rng = np.random.default_rng(1)
    m = q.Machine()
    m.v = rng.normal(0, 1, m.v.shape).astype(np.float32)
    at, x = np.array([3, 9, 500, 65540]), rng.normal(0, 1, 4)
    v = m.v[at].astype(float)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(4) for j in range(i))
    assert math.isclose(m.margin(at, x), pairs, rel_tol=1e-4)


def test_l1_leaves_few_weights():
    rng = np.random.default_rng(4)
    rows = [(np.unique(np.concatenate([rng.integers(10, 5000, 40), [1] if i % 3 == 0 else [2]])), int(i % 3 == 0)) for i in range(600)]
    at, values, _ = t.train(rows)
    assert 1 in at and len(at) < 200 and values[list(at).index(1)] > 0


def test_hash_table_forgets_and_grows():
    from barloom.llm.common import HashTable

    table = HashTable(lambda w: (len(w), ord(w[0])), 2, most=10)
    rng = random.Random(3)
    for size in (3, 6, 4, 25, 2, 40, 9):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(size)]
        assert table.hashes(words).tolist() == [[len(w) for w in words], [ord(w[0]) for w in words]]


def test_sample_is_bounded(spark):
    """At most so many rows, however often a doc_id is repeated, and the same ones in any order."""
    from barloom.llm.common import labelled_sample

    rows = [(i % 40, f"text {i}", None, None) for i in range(8000)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, i % 2, None) for i in range(40)], LABELS)
    got = labelled_sample(docs, labels, "toxic", 4, 2, 10).collect()
    assert len(got) == 10
    assert sorted(map(tuple, got)) == sorted(map(tuple, labelled_sample(docs.repartition(7), labels, "toxic", 4, 2, 10).collect()))


def test_machine_against_plain_loops():
    """AdaGrad steps on all pairs of features by the letter, and the same scores."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(30):
        at = np.sort(rng.choice(40, 6, replace=False))
        rows.append((at, rng.random(6), int(at[0] < 5)))
    got = q.Machine().train(rows, 2)
    plain = q.Machine()
    w0, w, v = 0.0, plain.w[:40].astype(float), plain.v[:40].astype(float)
    g0, gw, gv = 1e-2, np.full(40, 1e-2), np.full(v.shape, 1e-2)
    ones, order = sum(y for *_, y in rows), np.random.default_rng(3)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            margin = w0 + sum(w[a] * b for a, b in zip(at, x)) + sum(v[at[i]] @ v[at[k]] * x[i] * x[k] for i in range(6) for k in range(i))
            g = (1 / (1 + math.exp(-margin)) - y) * 0.5 * len(rows) / (ones if y else len(rows) - ones)
            dw = [g * b + q.DECAY * w[a] for a, b in zip(at, x)]
            dv = [g * b * sum(v[c] * d for c, d in zip(at, x) if c != a) + q.DECAY * v[a] for a, b in zip(at, x)]
            for a, d, e in zip(at, dw, dv):
                gw[a] += d * d
                gv[a] += e * e
                w[a] -= q.RATE * d / math.sqrt(gw[a])
                v[a] -= q.RATE * e / np.sqrt(gv[a])
            g0 += g * g
            w0 -= q.RATE * g / math.sqrt(g0)
    assert math.isclose(got.w0, w0, abs_tol=1e-4) and np.allclose(got.w[:40], w, atol=1e-4) and np.allclose(got.v[:40], v, atol=1e-4)


def test_features_and_ftrl_against_plain_loops(monkeypatch):
    """The feature set by sets of tuples, and FTRL-proximal coordinate by coordinate."""
    words = "The the, cat! sat on «the» catalogue mat".split()
    bare = ["the", "the", "cat", "sat", "on", "the", "catalogue", "mat"]
    want = {(w,) for w in bare} | set(zip(bare, bare[1:])) | {(a, None, b) for a, b in zip(bare, bare[2:])} | {("stem", w[:k]) for w in bare for k in t.STEMS if len(w) > k}
    assert len(t.Features().set(" ".join(words))) == len(want)
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(np.arange(1, 30), 8, replace=False)), int(i % 3 == 0)) for i in range(90)]
    rows = [(np.union1d(x, [40]) if y else x, y) for x, y in rows]
    monkeypatch.setattr(t, "L1", 0.4)
    at, values, intercept = t.train(rows, 2)
    z, n, z0, n0, order = dict.fromkeys(range(50), 0.0), dict.fromkeys(range(50), 0.0), 0.0, 0.0, np.random.default_rng(7)
    weight = lambda z, n, l1: 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((t.BETA + math.sqrt(n)) / t.ALPHA + t.L2)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            w0 = weight(z0, n0, 0)
            g = 1 / (1 + math.exp(-(w0 + sum(weight(z[k], n[k], 0.4) for k in x)))) - y
            for k in x:
                w = weight(z[k], n[k], 0.4)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / t.ALPHA * w
                n[k] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / t.ALPHA * w0
            n0 += g * g
    want = {k: weight(z[k], n[k], 0.4) for k in z if abs(z[k]) > 0.4}
    assert sorted(want) == at.tolist() and np.allclose(values, [want[k] for k in sorted(want)], atol=1e-5) and math.isclose(intercept, weight(z0, n0, 0), abs_tol=1e-9)
