"""Rule bitmask ledger: every rule is evaluated once, policies are masks over the bits.

`ledger` stores, per document, the measurements and one long of failure bits.
A policy is a versioned mask: a document is kept if none of the policy's bits is
set. `apply_policy` and `ablate` never look at a text again: they work on the
bits alone, ablations after a pre-aggregation to one row per distinct bit set
(at most 2 ** len(RULES) rows, whatever the corpus holds).

Null texts and texts without words measure 0 everywhere and fail too_few_words.
Repeated rows stay; each is judged alone. An empty table gives an empty ledger.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_and_text, map_batches

WINDOW = 8
#: Fixed character classes of the measurements (Latin letters with both cases).
SYMBOLS = "#*$%&|<>"
UPPER = ((0x41, 0x5A), (0xC0, 0xD6), (0xD8, 0xDE))
LOWER = ((0x61, 0x7A), (0xDF, 0xF6), (0xF8, 0xFF))

#: Name and failing condition, in bit order. All are integer comparisons over the measurements.
RULES = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("upper_case", "n_upper + n_lower > 0 and 100 * n_upper > 50 * (n_upper + n_lower)"),
    ("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "10 * word_chars < 20 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("echoed_words", "100 * n_echo > 20 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versioned policies; the last is in force.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BIT["symbols"] | BIT["upper_case"],
    "v3": sum(BIT.values()),
}
CURRENT = "v3"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_lines", "n_echo")


def _between(codes: np.ndarray, ranges) -> int:
    return sum(int(np.count_nonzero((codes >= a) & (codes <= b))) for a, b in ranges)


def measure(text: str) -> tuple[int, ...]:
    """The values of MEASURES, over the whole text."""
    words = WORD.findall(text)
    n = len(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        seen, again = set(), set()
        if len(set(windows)) < len(windows):
            for w in windows:
                (again if w in seen else seen).add(w)
            inside = np.zeros(n, bool)
            for at in compress(range(len(windows)), map(again.__contains__, windows)):
                inside[at : at + WINDOW] = True
            repeated = int(inside.sum())
    return (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, _between(codes, UPPER), _between(codes, LOWER), len(lines), sum(map(str.__eq__, words, words[1:])))


def _measurer():
    def batch(rows):
        found = list(zip(*map(measure, rows.column("text").to_pylist()))) or [()] * len(MEASURES)
        return {"doc_id": rows.column("doc_id"), **dict(zip(MEASURES, found))}

    return batch


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and fail_bits of every row of docs, in one pass without a shuffle."""
    measured = map_batches(id_and_text(docs), _measurer, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"if({rule}, {BIT[name]}L, 0L)" for name, rule in RULES)
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(entries: DataFrame, version: str = CURRENT, into: str = "kept") -> DataFrame:
    """Adds boolean `into`: no rule of the policy failed."""
    return entries.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablate(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of the policy: n_failed, n_only (failed by it alone), kept_without.

    Bit sets are counted first (partial aggregation), then the few distinct ones are folded.
    """
    mask = POLICIES[version]
    names = [n for n, _ in RULES if BIT[n] & mask]
    sets = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in names)))
    each = sets.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    here = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(here, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | alone, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def query(docs: DataFrame) -> DataFrame:
    """The ledger with the base rule's and the current policy's verdicts."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    judged = apply_policy(ledger(docs)).withColumn("base_failed", base)
    return judged.select("doc_id", *MEASURES[:5], "base_failed", (F.col("kept") & ~base).alias("kept"), *MEASURES[5:], "fail_bits")


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
l AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT r, k FROM g GROUP BY r, k HAVING count(*) > 1),
cover AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(i, i + 8)) AS p FROM g JOIN twice USING (r, k)) GROUP BY r),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^a-zß-öø-ÿ]', '', 'g'))::BIGINT AS n_lower, len(ls)::BIGINT AS n_lines,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_echo
  FROM w JOIN l USING (r) LEFT JOIN cover USING (r)),
b AS (
  SELECT *, ({" | ".join(f"(CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END)" for name, rule in RULES)})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed,
  (fail_bits & {BASE | POLICIES[CURRENT]}) = 0 AS kept, n_upper, n_lower, n_lines, n_echo, fail_bits FROM b
"""
