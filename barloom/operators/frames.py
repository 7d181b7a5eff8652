"""Row frames over long series, in blocks.

A window over (symbol) alone puts a whole history in one task. Here rows get their
place in the series first, from counts per chunk of time, and are then dealt in blocks
of ROWS places; rows near a border also go to the neighbour that looks back or ahead at
them. A frame of fixed size over (symbol, block) then sees what it would have seen over
the series, and no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 30 * 86400  # seconds
ROWS = 4096
GROUP = 256  # block ends folded in one task
LEVELS = 2


def in_block():
    """The window of a row's block."""
    return Window.partitionBy("symbol", "block").orderBy("rn")


def numbered(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds rn (0-based place by time in the symbol) and n (its rows).

    The running sum is over one row a chunk; rows are sorted inside a chunk only.
    """
    own = bars.withColumn("chunk", F.floor(F.col("time") / chunk))
    sizes = own.groupBy("symbol", "chunk").agg(F.count("*").alias("size"))
    series = Window.partitionBy("symbol")
    before = F.coalesce(F.sum("size").over(series.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("symbol", "chunk", before.alias("first"), F.sum("size").over(series).alias("n"))
    place = F.row_number().over(Window.partitionBy("symbol", "chunk").orderBy("time")) - 1
    return own.join(sizes, ["symbol", "chunk"]).withColumn("rn", (F.col("first") + place).cast("long")).drop("chunk", "first")


def framed(bars: DataFrame, before: int = 0, after: int = 0, rows: int = ROWS) -> DataFrame:
    """numbered() bars with `block` and `own`; frames over in_block() reach `before` rows back and `after` ahead.

    Keep only rows with `own` once the frames are computed.
    """
    rows = max(rows, before, after)
    home, inside = F.floor(F.col("rn") / rows), F.col("rn") % rows
    to = [home]
    if before:
        to.append(F.when(inside >= rows - before, home + 1))
    if after:
        to.append(F.when((inside < after) & (home > 0), home - 1))
    dealt = numbered(bars).withColumn("block", F.explode(F.filter(F.array(*to), lambda b: b.isNotNull())))
    return dealt.withColumn("own", F.floor(F.col("rn") / rows) == F.col("block"))


def past(size: int):
    """The frame of the last `size` rows."""
    return in_block().rowsBetween(-(size - 1), 0)


def _starts(ends: DataFrame, inputs: list[str], factor: float, group: int, levels: int) -> DataFrame:
    """The value each part begins with: start[p+1] = factor * start[p] + end[p], start[0] = 0; ends: symbol, part, inputs.

    `group` parts are folded at a time, then the groups' ends in the same way, `levels` times over;
    what is left at the top, one row for group ** levels parts, is folded by symbol.
    """
    keys = ["symbol", "group"] if levels else ["symbol"]
    if levels:
        ends = ends.withColumn("group", F.floor(F.col("part") / group))
    begun = F.expr(f"cast(array() as array<struct<part:bigint,{','.join(f'{y}:double' for y in inputs)}>>)")
    start = F.struct(*(F.lit(0.0).alias(y) for y in inputs), begun.alias("out"))

    def step(state, x):
        begins = F.struct(x["part"].alias("part"), *(state[y].alias(y) for y in inputs))
        passed = [(F.lit(factor) * state[y] + x[y]).alias(y) for y in inputs]
        return F.struct(*passed, F.array_append(state["out"], begins).alias("out"))

    parts = F.array_sort(F.collect_list(F.struct("part", *inputs)))
    folded = ends.groupBy(*keys).agg(F.aggregate(parts, start, step).alias("f"))
    own = folded.select(*keys, F.explode("f.out").alias("o")).select(*keys, "o.part", *(F.col(f"o.{y}") for y in inputs))
    if not levels:
        return own
    tops = folded.select("symbol", F.col("group").alias("part"), *(F.col(f"f.{y}") for y in inputs))
    upper = _starts(tops, inputs, factor**group, group, levels - 1)
    upper = upper.select("symbol", F.col("part").alias("group"), *(F.col(y).alias(f"upper_{y}") for y in inputs))
    reach = F.pow(F.lit(factor), F.col("part") % group)
    return own.join(upper, ["symbol", "group"]).select("symbol", "part", *((F.col(y) + reach * F.col(f"upper_{y}")).alias(y) for y in inputs))


def recurrence(rows: DataFrame, inputs: dict[str, str], keep: float, block: int = 512, group: int = GROUP, levels: int = LEVELS) -> DataFrame:
    """Adds y[t] = keep * y[t-1] + u[t] for each output: input in `inputs`; rows: symbol, rn and more.

    Inside a block y is a running sum of u / keep ** place, scaled back. A block's start
    value comes from the ends of the blocks before, folded in levels of `group` rows.
    """
    if keep == 0:
        return rows.withColumns({y: F.col(u) for y, u in inputs.items()})
    own = rows.withColumn("part", F.floor(F.col("rn") / block)).withColumn("at", (F.col("rn") % block).cast("double"))
    w = Window.partitionBy("symbol", "part").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(keep), F.col("at"))
    own = own.withColumns({f"local_{y}": scale * F.sum(F.col(u) / scale).over(w) for y, u in inputs.items()})
    # all blocks but a symbol's last, whose end nothing follows, hold `block` rows
    ends = own.groupBy("symbol", "part").agg(*(F.max_by(f"local_{y}", "rn").alias(y) for y in inputs))
    starts = _starts(ends, list(inputs), keep**block, group, levels)
    starts = starts.select("symbol", "part", *(F.col(y).alias(f"start_{y}") for y in inputs))
    joined = own.join(starts, ["symbol", "part"])
    values: dict[str, Column] = {y: F.col(f"local_{y}") + F.pow(F.lit(keep), F.col("at") + 1) * F.col(f"start_{y}") for y in inputs}
    return joined.withColumns(values).drop("part", "at", *(f"local_{y}" for y in inputs), *(f"start_{y}" for y in inputs))
