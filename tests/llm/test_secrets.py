import hashlib
import random
import re

import pytest

from barloom.llm import secrets as s
from barloom.llm import trigrams

SCHEMA = "doc_id long, text string, h string, spans string, n_chars long"


def brute(text):
    found = []
    for k, r in enumerate(s.RULES):
        for m in re.compile(r.pattern, re.ASCII).finditer(text or ""):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), k, m.end()))
    found.sort()
    write = lambda xs: ",".join(f"{s.RULES[k].kind}:{a}:{b}" for a, k, b in xs)
    base = [x for x in found if x[1] < s.BASE]
    return (*(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(write(base).encode()).hexdigest(), write(found)), found


def texts():
    rng = random.Random(9)
    parts = ["token", "secret: token: abcdefgh", 'Password = "hunter2.x"', "API_KEY:abc", "api_key='a+b/c=ddd'", "passwd=12345", "AKIA" + "Z9" * 9, "AKIAAKIA" + "A" * 12, "AKIASHORT",
             "a1" * 12, "deadbeef" * 2, "0123456789abcdef" * 3, "ghp_" + "a" * 36, "xoxb-1234567890ab", "AIza" + "b" * 35, "sk_live_" + "c" * 20, "SG." + "a" * 22 + "." + "b" * 43,
             "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl", "-----BEGIN RSA PRIVATE KEY-----", "https://user:pa55@host", "-----BEGIN " + "VERY " * 9 + "PRIVATE KEY-----", "ftp://" + "u" * 90 + ":" + "p" * 300 + "@h", "ſecret=abcdefgh", "TOKEN\u0130=abcdefgh", "é日🙂", " ", "\n", "=", '"', "words of text"]
    yield from (None, "", "tok en = abcdefgh", "token=" + "f" * 30)
    for _ in range(120):
        yield "".join(rng.choice(parts) + rng.choice(["", " ", "é "]) for _ in range(rng.randrange(1, 14)))
    yield "token = abcdefg " * 3000 + "é" * 50_000


def test_spans(spark):
    rows = [(i, t, "x", "y", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[7], (7, "other token=abcdefgh", "x", "y", 1), (None, "secret=abcdefgh", "x", "y", 1)]
    got = s.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *brute(r[1])[0])) for r in rows)
    assert s.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mask(spark):
    rows = [(i, t, "x", "y", -1) for i, t in enumerate(texts())]
    rows.append(rows[9])
    want = []
    for r in rows:
        out, at, found = "", 0, brute(r[1])[1]
        for a, _, b in found:
            if a >= at:
                out += r[1][at:a] + s.MASK
            at = max(at, b)
        text = out + r[1][at:] if found else r[1]
        want.append((r[0], text, "x", "y", len(text) if found else -1))
    masked = s.mask(spark.createDataFrame(rows, SCHEMA))
    assert masked.columns == ["doc_id", "text", "h", "spans", "n_chars"]
    assert sorted(map(str, map(tuple, masked.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("rule", s.RULES, ids=lambda r: r.kind)
def test_queries_are_necessary(rule):
    sets = trigrams.query(rule.pattern)
    assert (sets is None) == (rule.kind == "hex")
    for text in filter(None, texts()):
        if sets and re.search(rule.pattern, text, re.ASCII):
            assert any(all(g in text.lower() for g in q) for q in sets)


def test_query_forms():
    assert trigrams.query("abcd") == [frozenset({"abc", "bcd"})]
    assert trigrams.query("(?:abc|xyz)[0-9]+") == [frozenset({"abc"}), frozenset({"xyz"})]
    assert trigrams.query("ab?cd") == [frozenset({"abc", "bcd"}), frozenset({"acd"})]
    assert trigrams.query("ab|cdef") is None and trigrams.query("[a-z]+") is None
    assert trigrams.query("foo.*bar") == [frozenset({"foo", "bar"})]


def test_index(spark):
    """Posting lists against plain search, and no candidate lacks the trigram that texts are chosen by."""
    rows = [(i, t, "x", "y", 0) for i, t in enumerate(texts())]
    keyed = s._keyed(spark.createDataFrame(rows, SCHEMA))
    grams = sorted({g for _, q in s._plans(s.RULES) for g in q})
    index = s.postings(keyed, grams).cache()
    got = sorted((r["doc_id"], grams[r["gram"]]) for r in index.collect())
    lower = {r["doc_id"]: r["t"] for r in keyed.selectExpr("doc_id", "lower(text) AS t").collect()}
    assert got == sorted((i, g) for i, t in lower.items() for g in grams if g in t)
    found = {r["doc_id"]: r["rules"] for r in s.candidates(index, grams, s.RULES).collect()}
    want = {}
    for i, q in s._plans(s.RULES):
        for d, t in lower.items():
            if all(g in t for g in q):
                want[d] = want.get(d, 0) | 1 << i
    assert found == want
    few = s.rarest(index, grams, s.RULES)
    assert all(any(g in lower[d] for g in few) for d in found)
