from collections import Counter

from barloom.llm import quality_rules as q

SCHEMA = "doc_id long, text string, fail_bits string, n_words string"


def brute_repeat(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(inside)


def test_edges_and_clashing_columns(spark):
    text = "a b c d e f g h i " * 3 + "tail\nline\nline\n \n"
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, text, "x", "y"), (3, text, "x", "y"), (4, "x" * 200_000, None, None), (None, "# *", None, None)]
    got = sorted(map(tuple, q.query(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *q.MEASURES).collect()), key=str)
    by = {r[0]: dict(zip(q.MEASURES, r[1:])) for r in got}
    assert len(got) == 6 and by[1] == by[2] == dict.fromkeys(q.MEASURES, 0)
    assert by[3]["n_repeat_words"] == brute_repeat(text.split()) and by[3]["n_dup_lines"] == 1 and by[3]["n_echo"] == 1
    assert by[4]["word_chars"] == 200_000 and by[None]["n_symbols"] == 2


def test_empty_table(spark):
    assert q.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_policies_and_ablation(spark):
    entries = spark.createDataFrame([(b,) for b in (0, 0, 1, 4, 4, 5, 8)], "fail_bits long")
    assert q.apply_policy(entries, "v1").filter("kept").count() == 5
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["kept_without"]) for r in q.ablate(entries, "v2").collect()}
    assert got["too_few_words"] == (2, 1, 3) and got["symbols"] == (3, 2, 4) and got["upper_case"] == (1, 1, 3)
    assert got["repeated_windows"] == (0, 0, 2)
