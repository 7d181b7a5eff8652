import random
import re
from collections import defaultdict

from barloom.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, size string, target string"


def brute_targets(size):
    """By the letter: share, stop at three times the size, share the excess again by weight."""
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(size.values()))
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        add = {s: rest * weight[s] / total for s in free}
        rest = 0.0
        for s in list(free):
            target[s] += add[s]
            if target[s] >= 3 * size[s]:
                rest += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                free.discard(s)
    return target


def rows_of(n, seed=3):
    rng = random.Random(seed)
    sources = ["b", "a", "zz", "é", None, "tiny"]
    rows = []
    for i in range(n):
        s = rng.choices(sources, [30, 8, 4, 8, 3, 0.3])[0]
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 50])), s, "x", "y"))
    return rows + [(n, None, "a", "x", "y"), (n, None, None, "x", "y"), (5, rows[5][1], rows[5][2], "x", "y"), (None, "one two", "b", None, None), (n + 1, "v " * 5000, "huge", "x", "y")]


def test_targets_near_and_repeatable(spark):
    rows = rows_of(900)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = m.mix(docs, fan=8).collect()
    again = m.mix(docs.repartition(3), fan=8).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(rows)
    size = defaultdict(int)
    for i, text, s, *_ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(size)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = r["source"]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] in [r["size"] * k for k in range(4)]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] + 1, s


def test_marginals(spark):
    """Over many independent documents each has about the same chance of its extra copy, whatever its size."""
    rows = [(i, "w " * (1 + i % 7), "s" if i % 2 else "t", None, None) for i in range(4000)]
    by = defaultdict(list)
    for r in m.mix(spark.createDataFrame(rows, SCHEMA)).collect():
        by[r["doc_id"] % 2, r["size"]].append(r["copies"])
    for (side, _), copies in by.items():
        share = 2 * (2 if side == 0 else 1) / 3
        assert abs(sum(copies) / len(copies) - share) < 0.12


def test_edges(spark):
    assert m.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = m.mix(spark.createDataFrame([(1, None, None, "x", "y"), (2, "", "a", "x", "y")], SCHEMA)).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_repeat(spark, tmp_path):
    rows = rows_of(300)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = m.repeat(docs)
    assert left.columns == docs.columns
    mixed = m.mix(m.whole_rows(docs).select("row.doc_id", "row.source", "row.text", "h1", "h2"), keyed=True)
    wordless = mixed.filter("size = 0").count()
    assert left.count() == mixed.agg(m.F.sum("copies")).first()[0] + wordless


def test_one_id_is_dealt_over_blocks(spark):
    """Rows of one doc_id, or of none, are no group: each is rounded for itself, in blocks of equal size."""
    rows = [(7 if i % 2 else None, "w " * (1 + i % 3 % 2), "s" if i % 3 else "t", "x", "y") for i in range(30_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    largest = []
    fold = m._fold

    def seen(items, level):
        largest.append(level)
        return fold(m.F.when(m.F.size(items) > 4 * m.FAN, m.F.raise_error("a block is too large").cast("array<struct<order:bigint,h1:bigint,h2:bigint,doc_id:bigint,size:bigint,mass:bigint>>")).otherwise(items), level)

    m._fold = seen
    try:
        got = m.mix(docs).groupBy("source", "doc_id", "size", "copies").count().collect()
    finally:
        m._fold = fold
    assert len(largest) >= 2 and sum(r["count"] for r in got) == len(rows)
    by = defaultdict(lambda: [0, 0])
    for r in got:
        by[r["source"], r["doc_id"], r["size"]][0] += r["count"]
        by[r["source"], r["doc_id"], r["size"]][1] += r["count"] * r["copies"]
    total = sum(1 + i % 3 % 2 for i in range(30_000))
    size = {s: sum(1 + i % 3 % 2 for i in range(30_000) if (i % 3 > 0) == (s == "s")) for s in "st"}
    for (s, *_), (n, copies) in by.items():
        assert abs(copies / n - {"s": 1, "t": 2}[s] / 3 * total / size[s]) < 0.05


def test_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(m, "PART", 4)
    got = m._numbered(spark.createDataFrame([("a", 11), ("b", 1), ("c", 8)], "k string, n long"), "n", "i").collect()
    assert sorted((r["k"], r["i"]) for r in got) == [("a", i) for i in range(1, 12)] + [("b", 1)] + [("c", i) for i in range(1, 9)]
