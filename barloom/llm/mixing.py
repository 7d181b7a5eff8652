"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

A source's documents all want target / source_size copies. The whole part is taken
for each; the fraction is rounded so that a source's words come within one document
of its target. A pair of documents moves mass (words) from one to the other, either
way with the chance that keeps both expectations, until one of them is integral;
the other goes on. Blocks of at most some FAN documents are folded in one row each,
their residuals form the blocks of the next level, and so on up to one residual a
source: a reduction tree of log_FAN(documents) levels, in which even a source that
holds a third of all rows is many equal blocks. Mass is integral (units of 2 ** -30
words), so nothing drifts. Rows that are alike get numbers, so that each is rounded for
itself and even a repeated (or null) doc_id is dealt over all blocks; chance comes from
hashes of doc_id, size and that number, so reruns agree, however files are split.

Null texts have size 0 and are never taken; a null source is a source like others,
last in order. Documents without words take 0. Repeated rows stay. A very long text is
one document like others, and may leave its source as far from the target as it is long.
Equal hashes only order rows arbitrarily. An empty table gives an empty result. Only
doc_id, source and text are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, Cuts, whole_rows

FAN = 64
UNITS = 1 << 30
PART = 1024  # rows made of one at once
MOST = 3  # a document is taken this many times at most


def sizes(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, source, size (words of the whole text) and the columns `keys`."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *keys)


def targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: source_size, n (documents with words), target, whole (copies), part (units of a copy).

    Weights repeat `cycle` in the order of the sources. A target stops at MOST times its
    source's size; what is over is shared again by weight. Sources in the order of
    MOST * size / weight are full up to some place, which running sums find at once.
    The windows run over one row a source, after partial sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("double"))
    room = F.lit(float(MOST)) * F.col("source_size")
    by_room = Window.orderBy(room / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    weights = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("share", left / weights).withColumn("full", room <= F.col("share") * F.col("weight"))
    share = F.min(F.when(~F.col("full"), F.struct(room / F.col("weight"), F.col("share").alias("share")))).over(all_)["share"]
    target = F.when(F.col("full"), room).otherwise(F.least(room, F.coalesce(share, F.lit(0.0)) * F.col("weight")))
    per = per.withColumn("target", target)
    copies = F.round(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) * UNITS).cast("long")
    return per.select("source", "source_size", "n", "target", F.floor(copies / UNITS).cast("long").alias("whole"), (copies % UNITS).alias("part"))


def _chance(*parts) -> F.Column:
    """In [0, 1), from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: F.Column, level: int) -> F.Column:
    """struct(rest, done) of an array of struct(order, h1, h2, doc_id, size, mass): all but one decided, as struct(h1, h2, doc_id, size, extra)."""
    named = "h1:bigint,h2:bigint,doc_id:bigint,size:bigint"
    start = F.struct(F.lit(None).cast(f"struct<order:bigint,{named},mass:bigint>").alias("rest"), F.expr(f"cast(array() as array<struct<{named},extra:bigint>>)").alias("done"))
    same = lambda x: [x[c].alias(c) for c in ("h1", "h2", "doc_id", "size")]

    def moved(x, mass):
        return F.struct(x["order"].alias("order"), *same(x), mass.alias("mass"))

    def settled(x, extra):
        return F.struct(*same(x), F.lit(extra).cast("bigint").alias("extra"))

    def pair(state, b):
        a, done = state["rest"], state["done"]
        space_a, space_b = a["size"] * UNITS - a["mass"], b["size"] * UNITS - b["mass"]
        up, down = F.least(space_a, b["mass"]), F.least(a["mass"], space_b)
        rise = _chance(F.lit(level), a["order"], b["order"], a["doc_id"], b["doc_id"]) * (up + down) < down
        go = lambda rest, mass, out, extra: F.struct(moved(rest, mass).alias("rest"), F.array_append(done, settled(out, extra)).alias("done"))
        return (
            F.when(a.isNull(), F.struct(b.alias("rest"), done.alias("done")))
            .when(rise & (space_a <= b["mass"]), go(b, b["mass"] - up, a, 1))
            .when(rise, go(a, a["mass"] + up, b, 0))
            .when(a["mass"] <= space_b, go(b, b["mass"] + down, a, 0))
            .otherwise(go(a, a["mass"] - down, b, 1))
        )

    return F.aggregate(F.array_sort(items), start, pair)


def _numbered(df: DataFrame, times: str, into: str) -> DataFrame:
    """Each row as often as `times` says, numbered from 1; long runs in parts, so that no array is long."""
    parts = df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / PART))))
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PART).cast("long"), F.col(times) - F.col("__part") * PART)))
    return parts.select(*df.columns, "__part", number.alias("__number")).withColumn(into, F.col("__part") * PART + F.col("__number")).drop("__part", "__number")


def mix(docs: DataFrame, keyed: bool = False, fan: int = FAN) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of every row of docs.

    keyed: docs has long columns h1 and h2 that tell its rows apart; they are returned too.
    """
    cuts, keys = Cuts(docs.sparkSession), ("h1", "h2")
    base = docs.select("doc_id", "source", "text", *(F.col(k) if keyed else F.lit(0).cast("long").alias(k) for k in keys))
    sized = cuts.cut(sizes(base, *keys))
    per = cuts.cut(targets(sized))  # one row a source
    largest = per.agg(F.max("n")).first()[0] or 0

    alike = sized.groupBy("doc_id", "source", "size", *keys).agg(F.count("*").alias("times"))
    each = _numbered(alike, "times", "number")
    known = each.join(per, each["source"].eqNullSafe(per["source"])).select("doc_id", *keys, "number", "size", "source_size", "target", "whole", "part", "n", per["source"])
    open_ = (F.col("size") > 0) & (F.col("part") > 0)
    keep = ("source", "source_size", "target", "whole")
    known = cuts.cut(known)  # read twice
    even = known.filter(~open_).select("doc_id", *keys, "size", *keep, F.lit(0).cast("long").alias("extra"))

    order = F.xxhash64(F.lit("order"), "doc_id", "size", "number", *keys)
    item = F.struct(order.alias("order"), *keys, "doc_id", "size", (F.col("size") * F.col("part")).alias("mass"))
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id", "size", "number", *keys), F.ceil(F.col("n") / fan))
    level, parts, blocks = 0, [even], -(-largest // fan)
    rows = known.filter(open_).select(*keep, block.alias("block"), item.alias("item"))
    while True:
        folded = rows.groupBy(*keep, "block").agg(_fold(F.collect_list("item"), level).alias("f"))
        folded = cuts.cut(folded.select(*keep, "block", "f.rest", "f.done"))
        done = folded.select(*keep, F.explode("done").alias("d"))
        parts.append(done.select("d.doc_id", "d.h1", "d.h2", "d.size", *keep, "d.extra"))
        if blocks <= 1:
            break
        level, blocks = level + 1, -(-blocks // fan)
        rows = folded.select(*keep, F.floor(F.col("block") / fan).alias("block"), F.col("rest").alias("item"))
    last = _chance(F.lit("last"), "rest.order", "rest.doc_id") * F.col("rest.size") * UNITS < F.col("rest.mass")
    parts.append(folded.select("rest.doc_id", "rest.h1", "rest.h2", "rest.size", *keep, F.when(last, 1).otherwise(0).cast("long").alias("extra")))
    out = reduce(DataFrame.unionByName, parts)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0)
    out = out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("long").alias("copies"), "source", *keys)
    return out if keyed else out.drop(*keys)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs)


def repeat(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns; documents without words stay once.

    Rows are told apart by what they hold, so the result doesn't depend on the cores that read them.
    """
    cuts, placed = Cuts(docs.sparkSession), whole_rows(docs)
    mixed = mix(placed.select("row.doc_id", "row.source", "row.text", "h1", "h2"), keyed=True)
    taken = mixed.groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).alias("copies"))
    taken = cuts.cut(taken.filter("copies > 0"))
    alone = placed.join(taken.filter("rows = 1").drop("rows"), ["h1", "h2"])
    equal = placed.join(taken.filter("rows > 1").drop("rows"), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    return _numbered(alone.unionByName(equal), "copies", "number").select("row.*")
