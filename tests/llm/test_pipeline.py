import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_jaccard_join import brute as brute_classes
from test_mixing import brute_targets
from test_secrets import brute as brute_spans

import corpus_pipeline as cp
from barloom.llm import bpe, secrets, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = ["vilegrub", "nastyword"]
        if i % 7 == 0:
            words[9:9] = ["token", "=", '"' + "ab12" * 5 + '"']
        text = " ".join(words)
        docs.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
        labels.append((i, 1, int(toxic)))
        if i % 5 == 0:
            docs.append((1000 + i, text + " tail", "en", "s1", len(text) + 5))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "\n ", "en", "s2", 2), docs[3]]
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, tables, tmp_path):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tables)
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept.append([tuple(r) for r in docs.collect()])
        docs = spark.read.parquet(str(tmp_path / name))
    start, clean, single, masked, mixed = kept

    toxic = {i for i, t, *_ in start if t and "vilegrub" in t}
    assert sorted(map(str, clean)) == sorted(str(r) for r in start if r[0] not in toxic)

    classes = {i: c for i, c, _ in brute_classes(clean)}
    wordless = {i for i, t, *_ in clean if not (t or "").split()}
    assert sorted(r[0] for r in single) == sorted({classes[r[0]] for r in clean if r[0] not in wordless} | wordless)

    for before, after in zip(sorted(single, key=str), sorted(masked, key=str)):
        text, at, found = "", 0, brute_spans(before[1])[1]
        for a, _, b in found:
            if a >= at:
                text += before[1][at:a] + secrets.MASK
            at = max(at, b)
        assert after == ((before[0], text + before[1][at:], *before[2:4], len(text + before[1][at:])) if found else before)

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in masked:
        sizes[r[3]] += size(r[1])
    for r in mixed:
        taken[r[3]] += size(r[1])
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 64 for s in sizes)
    assert set(mixed) <= set(masked) and max(Counter(mixed).values()) <= 3

    with open(bpe.default_path(), "rb") as f:
        encoder = bpe.Encoder(f.read())
    want = []
    for i, t, *_ in mixed:
        ids = np.array(encoder.plain(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids.tobytes()))
    got = [(*r[:4], bytes(r["ids"])) for r in docs.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(map(str, cp.run(spark, tables).collect())) == sorted(map(str, docs.collect()))


def test_empty(spark, tables):
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, tables).count() == 0


def test_stage_names_and_columns(spark, tables):
    """Further columns, of names that operators use inside, go through."""
    own = "size key h h1 h2 row spans masked copies rows times number root first1 stays __row __copy __copies __part __number __id __h __spans __masked __text_hash block item rest a.b".split()
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("*", *(f"'keep{i}' AS `{c}`" for i, c in enumerate(own)), "map('k', doc_id) AS m")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:-1] for r in out.collect()} == {tuple(f"keep{i}" for i in range(len(own)))}, name
        assert all(r["m"] == {"k": r["doc_id"]} for r in out.collect()), name


def test_rows_stay_the_same_when_cores_change(spark, tables, tmp_path):
    """Splits are packed by the cores that are alive: neither ids nor results may depend on it, between or inside calls."""
    spark.read.parquet(f"{tables}/documents.parquet").repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    docs = docs.unionByName(docs.filter("doc_id % 9 = 0").withColumn("lang", cp.bpe.F.lit("again"))).unionByName(docs.filter("doc_id % 11 = 0"))
    key = "spark.sql.leafNodeDefaultParallelism"
    before, got = spark.conf.get(key, None), {}
    try:
        for made, read in ((12, 12), (12, 3), (2, 7)):
            for name, stage in cp.STAGES[1:4]:
                spark.conf.set(key, made)
                out = stage(spark, docs, tables)
                spark.conf.set(key, read)
                got.setdefault(name, []).append(sorted(map(str, out.collect())))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    for name, runs in got.items():
        assert runs[0] and all(r == runs[0] for r in runs), name
    assert toxicity.THRESHOLD == 0.3
