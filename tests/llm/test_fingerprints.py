import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import fingerprints as f

SCHEMA = "doc_id long, text string, place string, range string"
POWERS = f.Powers()


@settings(max_examples=150, deadline=None)
@given(st.text("ab é🙂", max_size=60), st.text("ab é🙂", max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = (f.Prefixes(f.codes_of(t), POWERS) for t in (a, b))
    i, k = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    want = 0
    while i + want < len(a) and k + want < len(b) and a[i + want] == b[k + want]:
        want += 1
    assert x.common(i, y, k) == want
    size = data.draw(st.integers(0, min(len(a) - i, len(b) - k)))
    assert x.same(i, y, k, size) == (a[i : i + size] == b[k : k + size])


def test_fold():
    x = np.array([0, 1, (1 << 31) - 1, 1 << 31, (1 << 62) - 1, ((1 << 31) - 2) ** 2], np.uint64)
    assert f._fold(x).tolist() == [int(v) % int(f.P) for v in x]


def test_likeness():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    a, b = (" ".join(word() for _ in range(400)) for _ in range(2))
    fa, fb, fc = (f.Fingerprint(t, POWERS) for t in (a, b, f.edited(a, b)))
    assert f.likeness(fa, f.Fingerprint(a, POWERS)) == 1 and f.likeness(fa, fb) < 0.1
    assert 0.35 < f.likeness(fa, fc) < 0.7 and 0.35 < f.likeness(fb, fc) < 0.7
    shifted = f.Fingerprint("new start " + a, POWERS)
    assert f.likeness(fa, shifted) > 0.85
    assert f.likeness(f.Fingerprint.parse(str(fa)), f.Fingerprint.parse(str(fc))) == f.likeness(fa, fc)
    e = f.Fingerprint("", POWERS)
    assert f.likeness(e, e) == 1 and f.likeness(e, fa) == 0


@pytest.mark.parametrize("ranges", [2, 7, 40])
def test_rows(spark, ranges):
    rng = random.Random(1)
    texts = [None, "", "x", "one two", "é🙂" * 50, "w " * 40_000]
    rows = [(rng.randrange(-500, 500) if rng.random() < 0.9 else 7, rng.choice(texts) if rng.random() < 0.4 else " ".join(str(rng.random()) for _ in range(rng.randrange(1, 60))), "c", "c") for _ in range(120)]
    rows += [(None, "no id", "c", "c"), (None, None, "c", "c"), (1 << 62, "far away", "c", "c"), rows[5]]
    got = f.query(spark.createDataFrame(rows, SCHEMA), ranges).collect()
    order = sorted(((i is None, i or 0, t or "", i) for i, t, *_ in rows), key=lambda r: (r[0], r[1], r[2].encode()))
    want = []
    for k, (*_, t, i) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        e = f.edited(t, following)
        fp = [f.Fingerprint(x, POWERS) for x in (t, e, following)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(fp[0]), str(fp[1]), f.likeness(fp[0], fp[1]), f.likeness(fp[0], fp[2])))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_few(spark):
    assert f.query(spark.createDataFrame([], SCHEMA)).count() == 0
    (one,) = f.query(spark.createDataFrame([(4, "alone here", "c", "c")], SCHEMA)).collect()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()


def test_likeness_by_plain_code():
    """The ends' share is that of the longest common prefix and suffix, each floored to the grid, in short texts too."""
    rng = random.Random(8)
    for _ in range(400):
        a = "".join(rng.choice("xy") for _ in range(rng.randrange(1, 40)))
        cut = rng.randrange(len(a) + 1)
        b = a[:cut] + "".join(rng.choice("xy") for _ in range(rng.randrange(0, 20))) + a[rng.randrange(cut, len(a) + 1) :]
        if not b or a == b:
            continue
        head = len(os.path.commonprefix([a, b]))
        tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
        fa, fb = f.Fingerprint(a, POWERS), f.Fingerprint(b, POWERS)
        pa, pb = f.Prefixes(f.codes_of(a), POWERS), f.Prefixes(f.codes_of(b), POWERS)
        assert pa.common(0, pb, 0) == head
        floor = lambda n: max([g for g in f.GRID if g <= n], default=0)
        share = min(min(len(a), len(b)), floor(head) + floor(tail)) / max(len(a), len(b))
        # one word each: different spans, so the ends alone decide
        assert f.likeness(fa, fb) == pytest.approx(min(share, 1 - 1 / (1 + max(len(a), len(b))))), (a, b)
    assert f.likeness(f.Fingerprint("abcdefgh", POWERS), f.Fingerprint("abcdXXXX", POWERS)) == 0.5
