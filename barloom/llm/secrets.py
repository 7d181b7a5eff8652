"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's pattern yields a Boolean trigram query (`trigrams.query`). Each text is cut
into its trigrams once; the index holds its postings (trigram, document), of those that any
rule asks for, and is written. A query intersects posting lists by gathering, per document
and conjunction, the bits of the trigrams that are there; documents that fulfil one are
candidates. Only texts that hold the rarest trigram of some conjunction, by the lengths of
the lists, go to meet the candidates, so that hardly a text is shuffled, and candidates are
verified by the pattern. Rules without a mandatory trigram scan every text. Documents are
told apart by doc_id and a hash of the text, so nothing depends on the order of rows.

Offsets come from the lengths of what a pattern splits off and of its matches, summed
in order; they count code points, ends exclusive.

Null texts are empty: no spans. Repeated rows stay and have the same spans. Texts are
scanned whole, however long, and so are secrets: no rule bounds their length from above;
documents may hold any number of spans. Spans that begin together are in the order of RULES.
An empty table gives an empty result. Only doc_id and text are read; `mask` returns all
columns, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trigrams
from .common import Cuts, whole_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points
    group: int = 0  # whose length counts; 0 is the match


#: Base kinds first, in the order that ties in spans keep.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[^\s:/@]+:[^\s:/@]+@"),
)
BASE = 3
MASK = "[secret]"

KEY = ("doc_id", "h")


def _keyed(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), *more)


def _beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined with right on KEY, null ids equal; right's key is dropped."""
    right = right.withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), how).drop("__id", "__h")


def _plans(rules: tuple[Rule, ...]) -> list[tuple[int, list[str]]]:
    """(rule, trigrams) of every conjunction of the rules' queries."""
    return [(i, sorted(q)) for i, r in enumerate(rules) for q in trigrams.query(r.pattern) or []]


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id, h): the distinct trigrams of each lower-cased text that are among `grams`, as places in the list."""
    # looks ahead, so that trigrams overlap; a class for each place leaves most of the others out at once
    any_of = "(?=(" + "".join("[" + "".join(sorted({re.escape(g[i]) for g in grams})) + "]" for i in range(3)) + "))"
    own = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(any_of), F.lit(1)), F.array(*map(F.lit, grams)))
    places = F.create_map(*(x for i, g in enumerate(grams) for x in (F.lit(g), F.lit(i))))
    return keyed.select(*KEY, F.explode(own).alias("g")).select(F.element_at(places, F.col("g")).alias("gram"), *KEY)


def candidates(index: DataFrame, grams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, h, rules): bits of the rules whose trigram query a document's postings fulfil."""
    place = {g: i for i, g in enumerate(grams)}
    asked = [(place[g], i, k, 1 << bit, (1 << len(q)) - 1) for k, (i, q) in enumerate(_plans(rules)) for bit, g in enumerate(q)]
    plan = index.sparkSession.createDataFrame(asked, "gram int, rule int, part int, bit long, all long")  # as long as the rules are
    met = index.join(F.broadcast(plan), "gram").groupBy(*KEY, "rule", "part", "all").agg(F.bit_or("bit").alias("bits"))
    return met.filter(F.col("bits") == F.col("all")).groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def rarest(index: DataFrame, grams: list[str], rules: tuple[Rule, ...]) -> list[str]:
    """Of each conjunction the trigram with the shortest posting list; one row a trigram that rules ask for comes to the driver."""
    lengths = {r["gram"]: r["n"] for r in index.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    place = {g: i for i, g in enumerate(grams)}
    return sorted({min(q, key=lambda g: (lengths.get(place[g], 0), g)) for _, q in _plans(rules)})


def _matches(texts: DataFrame, rules: list[tuple[int, Rule]], wanted=None) -> DataFrame:
    """(doc_id, h, kind, start, end) of the rules' spans in texts; wanted: column of rule bits."""
    each = []
    for i, r in rules:
        pattern = F.lit(r.pattern)
        found = F.struct(
            F.lit(i).alias("kind"),
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length).alias("sizes"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(r.group)), F.length).alias("counted"),
        )
        there = F.regexp_like("text", pattern)
        each.append(F.when(there if wanted is None else (wanted.bitwiseAND(1 << i) != 0) & there, found))
    rows = texts.select(*KEY, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("f"))
    places = F.sequence(F.lit(0), F.size("f.sizes") - 1)
    one = F.transform(places, lambda i: F.struct(i.alias("i"), F.get("f.gaps", i).alias("gap"), F.get("f.sizes", i).alias("size"), F.get("f.counted", i).alias("counted")))
    rows = rows.select(*KEY, "f.kind", F.explode(one).alias("m")).select(*KEY, "kind", "m.*").distinct()  # repeated rows bring equal ones
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*KEY, "kind").orderBy("i"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in RULES)), F.col("kind") + 1)
    spans = rows.withColumn("end", end).filter(F.col("counted") >= least)
    return spans.select(*KEY, "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) of all rules' spans; h is the hash of the text, kind a place in RULES."""
    keyed = _keyed(docs)
    plans = {i: trigrams.query(r.pattern) for i, r in enumerate(RULES)}
    indexed = [(i, r) for i, r in enumerate(RULES) if plans[i]]
    scanned = [(i, r) for i, r in enumerate(RULES) if not plans[i]]
    cuts, grams = Cuts(docs.sparkSession), sorted({g for _, q in _plans(RULES) for g in q})
    index = cuts.cut(postings(keyed, grams))
    asked = cuts.cut(candidates(index, grams, RULES))
    few = rarest(index, grams, RULES)
    holds = F.transform(F.array(F.lower("text")), lambda t: reduce(Column.__or__, (F.contains(t, F.lit(g)) for g in few)))  # lower case once
    texts = _beside(keyed.filter(F.get(holds, F.lit(0))), asked, "inner")
    return _matches(texts, indexed, F.col("rules")).unionByName(_matches(keyed, scanned))


def _gathered(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _written(items):
    names = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    all_ = _keyed(docs).select(*KEY)
    found = _gathered(spans(docs))
    out = _beside(all_, found, "left")
    items = F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    of = lambda i: F.size(F.filter(items, lambda x: x["kind"] == i)).cast("long")
    counts = [of(i).alias(f"n_{RULES[i].kind}") for i in range(BASE)]
    base = F.filter(items, lambda x: x["kind"] < BASE)
    return out.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(items).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns; each span of the text, overlapping ones as one, reads MASK, and n_chars follows."""
    found = _gathered(spans(docs))
    own = whole_rows(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("h"))
    both = _beside(own, found, "left")
    text = F.col("row.text")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def put(state, x):
        new = F.concat(state["text"], part(state["at"], x["start"]), F.lit(MASK))
        return F.struct(F.when(x["start"] < state["at"], state["text"]).otherwise(new).alias("text"), F.greatest(state["at"], x["end"]).alias("at"))

    masked = F.aggregate("spans", start, put, lambda s: F.concat(s["text"], part(s["at"], F.length(text).cast("long"))))
    both = both.select("row", F.when(F.col("spans").isNotNull(), masked).alias("masked"))
    new = {"text": F.coalesce("masked", text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masked").isNull(), F.col("row.n_chars")).otherwise(F.length("masked")).cast(docs.schema["n_chars"].dataType)
    return both.select(*(new.get(c, F.col("row.`" + c.replace("`", "``") + "`")).alias(c) for c in docs.columns))


def _oracle() -> str:
    each = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(
            f"SELECT r, {i} AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS c, {r.least} AS least FROM w"
        )
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(each)}),
x AS (SELECT r, kind, i, g, m, c, least FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
s AS (
  SELECT r, kind, (list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i-1], lambda v: length(v))), 0))::BIGINT AS a, length(m[i]) AS n
  FROM x WHERE length(c[i]) >= least),
o AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({names}[kind + 1] || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) FILTER (kind < {BASE}) AS base,
    string_agg({names}[kind + 1] || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM w LEFT JOIN o USING (r)"""


ORACLE = _oracle()
