import random

import numpy as np
import pytest

from barloom.llm import jaccard_join as j
from barloom.llm.common import Cuts
from barloom.llm.components import components

SCHEMA = "doc_id long, text string, key string, class_id string"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    near = lambda a, b: bool(a and b) and 9 * len(a & b) >= 4 * (len(a) + len(b))
    links = [{k for k in range(len(rows)) if k != i and near(sets[i], sets[k])} for i in range(len(rows))]
    least, out = {}, []
    for i in range(len(rows)):
        if i not in least:
            todo, found = [i], {i}
            while todo:
                new = links[todo.pop()] - found
                found |= new
                todo += new
            ids = [rows[k][0] for k in found if rows[k][0] is not None]
            least |= dict.fromkeys(found, min(ids, default=None))
        out.append((rows[i][0], least[i], len(links[i])))
    return sorted(out, key=str)


def corpus(n=60, group=40, seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(60, 120))]
        if i % 2:
            words[10:10] = passage
        rows.append((i, " ".join(words)))
        for _ in range(rng.randrange(0, 4)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 1000, " ".join(copy)))
    base = [word() for _ in range(150)]
    for i in range(group):
        copy = list(base)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((5000 + i, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "two words"), (9004, "two  words"), (9005, "two words"), (9005, "two words"), (None, "two words"), (9006, "x " * 30_000), (9007, "x " * 200)]
    return [(*r, "c", "c") for r in rows]


def test_against_brute_force(spark):
    rows = corpus()
    got = j.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)


def test_large_nodes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "SMALL", 8)
    rows = corpus(20, 90, 4)
    for name, value in (("BLOCK", 16), ("TOKENS", 900)):
        with monkeypatch.context() as m:
            m.setattr(j, name, value)
            got = j.join(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)


def test_pairs_in_one_of_two_blocks(spark, monkeypatch):
    """A pair of near copies is counted once, wherever its two sets fall."""
    rng = random.Random(6)
    rows = []
    for i in range(24):
        words = [str(rng.random()) for _ in range(60)]
        rows += [(2 * i, " ".join(words), "c", "c"), (2 * i + 1, " ".join([*words, "more"]), "c", "c")]
    monkeypatch.setattr(j, "TOKENS", 60)
    got = j.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(i, i - i % 2, 1) for i in range(48)]


def test_runs_reach_the_recall():
    """Pairs other than those that `runs_for` has seen, at the threshold, if all nodes but the deepest are large."""
    rng, n, runs = np.random.default_rng(0), 3000, j.runs_for()
    assert 4 <= runs <= 16
    a = rng.integers(0, 1 << 32, (n, j.SKETCH), dtype=np.uint32)
    b = np.where(rng.random((n, j.SKETCH)) < 0.8, a, a ^ np.uint32(1))
    found, screened = np.zeros(n, bool), (a == b).mean(axis=1) >= j.AGREE
    for r in range(runs):
        member, path = j.walk(np.concatenate([a, b]), np.arange(2 * n), j.roots(r, 2 * n), j.FIRST)
        member, path = j.walk(np.concatenate([a, b]), member, path, j.DEEPEST - j.FIRST, j.LATER_FORKS)
        left = set(zip(member[member < n].tolist(), path[member < n].tolist()))
        found[[m - n for m, p in zip(member.tolist(), path.tolist()) if m >= n and (m - n, p) in left]] = True
    assert (found & screened).mean() >= 0.998, (found & screened).mean()


@pytest.mark.parametrize("small", [512, 1, 40])
def test_recall_end_to_end(spark, monkeypatch, small):
    """Pairs of texts at 0.8 to 0.85, with every cut, as nodes are, and as if none were small."""
    rng = random.Random(small)
    monkeypatch.setattr(j, "SMALL", small)
    rows, pairs = [], 700
    for i in range(pairs):
        words = [f"{rng.random():.6f}" for _ in range(rng.randrange(60, 140))]
        cut = (len(words) - 4) // 9  # so many shingles go
        other = words[:-cut] + [f"{rng.random():.6f}" for _ in range(cut)]
        x, y = shingles(" ".join(words)), shingles(" ".join(other))
        assert 0.8 <= len(x & y) / len(x | y) < 0.85
        rows += [(2 * i, " ".join(words), "c", "c"), (2 * i + 1, " ".join(other), "c", "c")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] == (2 * i, 1) for i in range(pairs))
    assert found >= pairs - 3, found
    assert all(got[k] == (k, 0) for i in range(pairs) for k in (2 * i, 2 * i + 1) if got[2 * i] != (2 * i, 1))


def test_shared_passage_fuses_nothing(spark, monkeypatch):
    """Texts of which much is one passage: their nodes are large and mixed, and only true pairs are linked."""
    rng = random.Random(2)
    word = lambda: f"{rng.random():.6f}"
    passage, rows = [word() for _ in range(60)], []
    for i in range(150):
        words = passage + [word() for _ in range(rng.choice([20, 40]))]
        rows.append((2 * i, " ".join(words), "c", "c"))
        rows.append((2 * i + 1, " ".join(words[:-1] + [word()]), "c", "c"))
    monkeypatch.setattr(j, "SMALL", 16)
    got = j.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components(Cuts(spark), spark.createDataFrame(edges, "u long, v long")).collect()}
    forest = j.Forest()
    for e in edges:
        forest.union(*e)
    nodes = {x for e in edges for x in e}
    assert got == {x: forest.find(x) for x in nodes if forest.find(x) != x}
    assert components(Cuts(spark), spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark, tmp_path):
    rows = corpus(20, 30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = j.keep_one(docs)
    classes = {}
    for i, c, _ in brute(rows):
        classes.setdefault((c, i if c is None else None), []).append(i)
    want = [i for i in (9000, 9001, 9002)] + [c for (c, _), ids in classes.items() if c not in (9000, 9001, 9002)]
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(want)


def test_empty(spark):
    assert j.join(spark.createDataFrame([], SCHEMA)).count() == 0
    assert j.join(spark.createDataFrame([(1, None, "c", "c")], SCHEMA).limit(5)).collect()[0]["n_links"] == 0
