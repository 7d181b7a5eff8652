import hashlib
import random

import numpy as np
import pytest

from barloom.llm import bpe

SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_path(), "rb") as f:
        return bpe.Encoder(f.read())


def cases():
    rng = random.Random(5)
    words = ["the", "don't", "it's", "  ", "\n\n", " \t ", "x" * 70, "été", "数学", "123456", "!!!", "'s", "'", " '", " ", "日", "🙂", "aaaa"]
    yield from (" " * 500, "a" * 1000, "'" * 300, "the" * 400, "\n" * 77 + "x", "0123456789" * 60)
    for _ in range(60):
        yield "".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 120)))
    for _ in range(40):
        yield "".join(rng.choice("abet hin'sl\n 9") for _ in range(rng.randrange(1, 600)))
    for _ in range(20):
        yield "".join(rng.choice("abcdetionsh") for _ in range(rng.randrange(200, 900)))


def test_tree_equals_whole(encoder):
    for text in cases():
        for leaf in (7, 64, 129):
            nodes = [encoder.leaf(text[i : i + leaf]) for i in range(0, len(text), leaf)]
            node = encoder.tree(nodes)
            assert node.ids.tolist() == encoder.plain(text), (text[:80], leaf)
            assert node.ends == encoder.splits(text) and node.id_ends[-1] == len(node.ids)


def test_trees_of_whole_texts(encoder):
    """Every text of more than a leaf, with and without places to part it, between ids of added tokens."""
    texts = [*cases(), "x" * 3000 + " y", "日本語" * 300, "é" * 999, "a1" * 700, "end<|endoftext|>" * 40, "w " * 2000, " \n" * 800, "\u3000" * 300 + "x" * 50, "a\x85b\xa0c " * 90]
    for leaf in (16, 250):
        assert [x.tolist() for x in encoder.encode(texts, leaf)] == [encoder.plain(t) for t in texts]
    assert encoder.encode([]) == []


def test_places_where_pre_tokens_begin(encoder):
    """At such a place both sides split as they would alone."""
    rng = random.Random(1)
    for text in cases():
        for m in bpe._BEGINS.finditer(text):
            if rng.random() < 0.2:
                at = m.start()
                assert encoder.splits(text) == encoder.splits(text[:at]) + [at + e for e in encoder.splits(text[at:])]


def test_ranks_equal_library(encoder):
    assert encoder.ranked is not None
    texts = [*cases(), "a<|endoftext|>b", "\x85\xa0 \x1c\x0b", "".join(map(chr, range(0x530)))]
    texts += [f"{chr(c)}a {chr(c)}1 .{chr(c)}" for c in range(0x530)]
    assert [x.tolist() for x in encoder.batch(texts)] == [encoder.plain(t) for t in texts]


def test_rows(spark, encoder):
    texts = [None, "", "short <|endoftext|> one", "a b" * 4000 + "<|endoftext|><|endoftext|>" + "x" * 5000 + " end\n", "q" * 9000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], None, None), (None, "z" * 4000, None, None)]
    made = bpe.encode(spark.createDataFrame(rows, SCHEMA), with_ids=True, leaf=512, long=3000).cache()
    got = sorted(made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), key=str)
    want = []
    for i, t, *_ in rows:
        ids = encoder.plain(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {(r["doc_id"], r["text"]) for r in bpe.decode(made).collect()} == {(i, t or "") for i, t, *_ in rows}
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0
