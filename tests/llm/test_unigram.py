import random

import pytest

from barloom.llm import unigram as u

SCHEMA = "doc_id long, text string, n_tokens string, path string"


@pytest.fixture(scope="module")
def vocab():
    with open(u.default_path(), "rb") as f:
        return u.vocabulary(f.read())


def texts():
    rng = random.Random(6)
    yield from ("", " ", "  ", "\n", " \n\n  x", "a" * 999, "<s> <0x0A> <unk>", "été 日本語 🙂🙂 \x00\t", " " * 200 + "end ", BLANKS)
    letters = "aeionrst   \n.,éüß日🙂" + u.BLANK
    for _ in range(400):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(1, 80)))


BLANKS = "▁a ▁▁ b"


def test_equals_library(vocab):
    counter, library = u.Counter(vocab), u.reference(vocab)
    own = list(texts())
    assert counter(own) == [len(library.encode(t, add_special_tokens=False).ids) for t in own]


def test_ties_and_unparted_vocabulary():
    """Few scores, so that most texts have tied paths; a piece with an inner blank turns the parting off."""
    rng = random.Random(4)
    for extra in ("", "b▁a"):
        pieces = {"<unk>": 0.0} | {p: -float(rng.randrange(1, 4)) for p in ("a", "b", "ab", "ba", "aab", "abab", "▁", "▁a", "bb", "baa", "aaa", extra) if p}
        counter, library = u.Counter(list(pieces.items())), u.reference(list(pieces.items()))
        for _ in range(500):
            text = "".join(rng.choice("ab  ") for _ in range(rng.randrange(1, 30)))
            got = library.encode(text, add_special_tokens=False)
            assert counter([text]) == [len(got.ids)], text


def test_runs_of_unknown_characters(vocab):
    """They are one run; without a piece of every byte it counts once, and the unknown piece joins it."""
    counter, library = u.Counter(vocab), u.reference(vocab)
    for text in ("<unk>", "a <unk>日", "\U0001f9ff<unk>", "<unk>\n\n<unk>", "<unk><unk> x\U0001f9ff\U0001f9ff", "\n<unk>\nb"):
        assert counter([text]) == [len(library.encode(text).ids)], text
    rng = random.Random(5)
    letters = "aaé日\n z"
    for held in ("", "é", "éz", "é日"):
        pieces = {"<unk>": 0.0, "a": -1.0, "aa": -1.5, "▁": -2.0, "a▁": -2.5} | {f"<0x{b:02X}>": -3.0 for b in held.encode()}
        counter, library = u.Counter(list(pieces.items())), u.reference(list(pieces.items()))
        assert counter(["xxya"]) == [len(library.encode("xxya").ids)]
        for _ in range(500):
            text = "".join(rng.choice([*letters, "<unk>"]) for _ in range(rng.randrange(1, 14)))
            assert counter([text]) == [len(library.encode(text).ids)], (held, text)


def test_rows(spark, vocab):
    rows = [(1, None, "c", "c"), (2, "", "c", "c"), (3, "hello world\n" * 20_000, "c", "c"), (3, "hello", "c", "c"), (3, "hello", "c", "c"), (None, "x", None, None)]
    library = u.reference(vocab)
    got = sorted(map(str, map(tuple, u.count_tokens(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(str((i, len(library.encode(t or "").ids))) for i, t, *_ in rows)
    assert u.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0
