"""The registered queries and, where SQL can say the same, their DuckDB text.

Bars are hourly bars of the events table (symbol = event_type). Predictions come from
integer arithmetic on ids, so that both engines have the same. Reals are rounded to six
places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import floor_divide_sql
from barloom.operators import clustering, ensemble, evaluation, indicators, resample, statistics, training, windows
from barloom.operators.frames import numbered
from barloom.sources import bars as bar_source
from barloom.sources import datasets, properties

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

L, T, STRIDE, POINT = 24, 6, 5, 0.1

BARS = """bars AS (
  SELECT event_type AS symbol, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS tick_volume, sum(value) AS real_volume, max(value) - min(value) AS spread
  FROM events GROUP BY 1, 2)"""
ROWS = BARS + ",\nr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
DIFFS = {"h": "max(high) OVER f - close", "l": "close - min(low) OVER f", "v": f"close - lead(close, {T}) OVER (PARTITION BY symbol ORDER BY time)"}
TARGETS = (
    ROWS
    + f""",
d AS (
  SELECT symbol, rn, n, time AS end_time, close AS entry, {", ".join(f"{v} AS {k}" for k, v in DIFFS.items())}
  FROM r WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND {T} FOLLOWING)),
raw AS (
  SELECT symbol, rn, end_time, h AS target_highest, l AS target_lowest, v AS target_value, entry
  FROM d WHERE rn >= {L - 1} AND (rn - {L - 1}) % {STRIDE} = 0 AND rn + {T} < n),
points AS (
  SELECT symbol, rn, end_time, {", ".join(f"{floor_divide_sql(f'target_{n}', str(POINT))} AS target_{n}" for n in ("highest", "lowest", "value"))}, entry FROM raw)"""
)
LABELS = (
    TARGETS
    + """,
least AS (SELECT symbol, trunc((quantile_cont(target_highest, 0.5) + quantile_cont(target_lowest, 0.5)) / 2)::BIGINT AS min_points FROM points GROUP BY 1),
labelled AS (
  SELECT p.*, min_points, CASE WHEN target_highest >= min_points AND target_highest > target_lowest THEN 0 WHEN target_lowest >= min_points AND target_lowest > target_highest THEN 1 ELSE 2 END AS label
  FROM points p JOIN least USING (symbol))"""
)
VOTES = "votes AS (SELECT event_id AS row_id, m AS model, ((event_id * event_id + event_id * m * 13 + m * m * 7) % 97) % 3 AS prediction, 5 - m AS priority FROM events, range(1, 5) t(m))"
SCORED = "scored AS (SELECT event_type AS symbol, event_id, ((event_id * event_id + 5 * event_id) % 89 % 3)::INT AS label, ((event_id * event_id + 5 * event_id + event_id % 4) % 89 % 3)::INT AS predicted FROM events)"


def query(name: str, sql: str | None = None, reals: str = ""):
    """Registers a function, its reals rounded, and its SQL."""
    names = reals.split()

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in names}) if names else df

        QUERIES[name] = run
        if sql:
            body = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else f"WITH {sql}"
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in names)}) FROM ({body})" if names else body
        return function

    return add


def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_source.from_events(spark, sf_dir)


def h1_windows(spark: SparkSession, sf_dir: str, *features: str) -> DataFrame:
    return windows.windows(h1(spark, sf_dir), L, STRIDE, features or ("time", *bar_source.FEATURES))


def point_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.targets(h1(spark, sf_dir), L, STRIDE, windows.TimeTarget(T, "points"), POINT)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = point_targets(spark, sf_dir)
    return statistics.labelled(found.join(statistics.min_target_points(found), "symbol"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("row_id"))
    m = F.explode(F.array(*map(F.lit, range(1, 5)))).alias("model")
    rows = ids.select("row_id", m)
    i, k = F.col("row_id"), F.col("model")
    return rows.select("row_id", "model", (((i * i + i * k * 13 + k * k * 7) % 97) % 3).cast("int").alias("prediction"), (5 - k).alias("priority"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), "event_id", ((i * i + 5 * i) % 89 % 3).cast("int").alias("label"), ((i * i + 5 * i + i % 4) % 89 % 3).cast("int").alias("predicted"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, one row per key, strided windows with targets and a moving average at their ends."""
    bars = windows.dedupe_last(h1(spark, sf_dir).withColumn("ingest", F.lit(1))).drop("ingest")
    found = windows.targets(bars, L, STRIDE, windows.TimeTarget(T, "raw_difference"))
    average = indicators.moving_average(bars, 12).withColumnRenamed("ma", "sma_12")
    return found.join(average.select("symbol", "rn", "sma_12"), ["symbol", "rn"])


# Bars and order

BAR_REALS = "open high low close tick_volume real_volume spread"


def _higher(width: int, low: str = "min") -> str:
    return BARS + (
        f"\nSELECT symbol, (floor(time / {width}) * {width})::BIGINT AS time, first(open ORDER BY time) AS open, max(high) AS high, {low}(low) AS low, last(close ORDER BY time) AS close,"
        " sum(tick_volume) AS tick_volume, sum(real_volume) AS real_volume, avg(spread) AS spread FROM bars GROUP BY symbol, floor(bars.time / %d)" % width
    )


query("bars_h1", BARS + "\nSELECT * FROM bars", BAR_REALS)(h1)
query("bars_h4", _higher(14400), BAR_REALS)(lambda s, d: resample.resample(h1(s, d), 240, 60))
query("bars_d1", _higher(86400), BAR_REALS)(lambda s, d: resample.resample(h1(s, d), 1440, 60))
query("bars_h4_compat_low", _higher(14400, "max"), BAR_REALS)(lambda s, d: resample.resample(h1(s, d), 240, 60, low_as_max=True))


@query(
    "window_bars_h4",
    ROWS
    + f""",
a AS (SELECT symbol, rn AS anchor FROM r WHERE rn >= {L - 1} AND (rn - {L - 1}) % {STRIDE} = 0),
x AS (SELECT a.symbol, anchor, floor(time / 14400)::BIGINT AS b, r.* EXCLUDE (symbol) FROM a JOIN r ON r.symbol = a.symbol AND r.rn BETWEEN anchor - {L - 1} AND anchor),
g AS (
  SELECT symbol, anchor, b * 14400 AS time, first(open ORDER BY rn) AS open, last(close ORDER BY rn) AS close, max(high) AS high, min(low) AS low, avg(spread) AS spread,
    sum(real_volume) AS real_vol, sum(tick_volume) AS tick_vol, row_number() OVER (PARTITION BY symbol, anchor ORDER BY b DESC) AS k FROM x GROUP BY symbol, anchor, b)
SELECT symbol, anchor AS rn, time, open, close, high, low, spread, real_vol, tick_vol FROM g WHERE k <= {L // 4 - 2}""",
    "open close high low spread real_vol tick_vol",
)
def window_bars(spark, sf_dir):
    made = resample.resample_windows(h1_windows(spark, sf_dir), 240, L, 60)
    names = ("time", "open", "close", "high", "low", "spread", "real_vol", "tick_vol")
    return made.select("symbol", "rn", F.explode(F.arrays_zip(*names)).alias("b")).select("symbol", "rn", "b.*")


@query(
    "dedupe_keep_last",
    BARS + ",\nt AS (SELECT symbol, time, close, 1 AS ingest FROM bars UNION ALL SELECT symbol, time, close + 1, 2 FROM bars WHERE (time // 3600) % 7 = 0)\nSELECT symbol, time, max_by(close, ingest) AS close FROM t GROUP BY ALL",
    "close",
)
def dedupe(spark, sf_dir):
    bars = h1(spark, sf_dir).select("symbol", "time", "close")
    again = bars.filter(F.floor(F.col("time") / 3600) % 7 == 0).withColumn("close", F.col("close") + 1)
    return windows.dedupe_last(bars.withColumn("ingest", F.lit(1)).unionByName(again.withColumn("ingest", F.lit(2)))).drop("ingest")


query(
    "symbol_properties",
    f"""{BARS} SELECT symbol, 'events' AS source, 'made' AS "group", 100000::INT AS contract_size, 1 / 10 ** (length(symbol) % 3) AS point_size, (length(symbol) % 3)::INT AS digits, min(time)::VARCHAR AS data_start, CASE WHEN symbol > 'p' THEN max(time)::VARCHAR END AS data_end FROM bars GROUP BY symbol""",
    "point_size",
)(lambda s, d: properties.parsed(property_texts(s, d)))


def property_texts(spark, sf_dir):
    """A JSON text for each symbol, as its file would hold it."""
    digits = (F.length("symbol") % 3).alias("digits")
    each = h1(spark, sf_dir).groupBy("symbol").agg(F.min("time").cast("string").alias("data_start"), F.max("time").cast("string").alias("last"))
    last = F.when(F.col("symbol") > "p", F.col("last")).alias("data_end")
    return each.select(F.to_json(F.struct("symbol", F.lit("events").alias("source"), F.lit("made").alias("group"), F.lit(100000).alias("contract_size"), (1 / F.pow(F.lit(10.0), digits)).alias("point_size"), digits, "data_start", last)).alias("value"))


query(
    "targets_own_point",
    f"{TARGETS}, o AS (SELECT *, 1 / 10.0::DOUBLE ** (length(symbol) % 3) AS p FROM raw) SELECT symbol, rn, end_time, " + ", ".join(f"{floor_divide_sql(f'target_{n}', 'p')} AS target_{n}" for n in ("highest", "lowest", "value")) + ", entry FROM o",
    "target_highest target_lowest target_value entry",
)(
    lambda s, d: windows.targets(properties.with_point(h1(s, d), properties.parsed(property_texts(s, d))), L, STRIDE, windows.TimeTarget(T, "points"), F.col("point_size"))
)

# Indicators


def _over(period: int) -> str:
    return f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"


query("sma_12", f"{ROWS}, i AS (SELECT *, avg(close) OVER {_over(12)} AS ma FROM r) SELECT symbol, time, rn, ma FROM i WHERE rn >= 11", "ma")(lambda s, d: indicators.moving_average(h1(s, d), 12))
SLOPE = f"{ROWS}, i AS (SELECT *, regr_slope(close, rn) OVER {_over(14)} AS slope, avg(close) OVER {_over(14)} AS m FROM r)"
query("slope_14", f"{SLOPE} SELECT symbol, time, rn, slope, m - slope * 6.5 AS intercept FROM i WHERE rn >= 13", "slope intercept")(lambda s, d: indicators.slope(h1(s, d), 14))
query("last_slope_14", f"{SLOPE} SELECT symbol, slope, m - slope * 6.5 AS intercept FROM i WHERE rn = n - 1", "slope intercept")(lambda s, d: indicators.last_slope(h1(s, d), 14))
TR = (
    ROWS
    + ",\np AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS c FROM r),\ntr AS (SELECT symbol, time, rn, greatest(high - low, abs(high - c), abs(low - c)) AS true_range FROM p WHERE rn >= 1)"
)
query("true_range", f"{TR} SELECT * FROM tr", "true_range")(lambda s, d: indicators.true_range(h1(s, d)))
query(
    "atr_14",
    "WITH RECURSIVE " + TR + ", w AS (SELECT symbol, 14::BIGINT AS rn, avg(true_range) AS atr FROM tr WHERE rn <= 14 GROUP BY 1"
    " UNION ALL SELECT w.symbol, tr.rn, (atr * 13 + true_range) / 14 FROM w JOIN tr ON tr.symbol = w.symbol AND tr.rn = w.rn + 1)"
    " SELECT w.symbol, tr.time, w.rn, atr FROM w JOIN tr USING (symbol, rn)",
    "atr",
)(lambda s, d: indicators.atr(h1(s, d)))
query(
    "rsi_14",
    "WITH RECURSIVE " + ROWS + ", p AS (SELECT symbol, time, rn, close - lag(close) OVER (PARTITION BY symbol ORDER BY time) AS c FROM r),"
    " u AS (SELECT symbol, time, rn, greatest(c, 0) AS up, greatest(-c, 0) AS down FROM p),"
    " w AS (SELECT symbol, 13::BIGINT AS rn, avg(up) AS pos, avg(down) AS neg FROM u WHERE rn BETWEEN 1 AND 13 GROUP BY 1"
    " UNION ALL SELECT w.symbol, u.rn, (pos * 13 + up) / 14, (neg * 13 + down) / 14 FROM w JOIN u ON u.symbol = w.symbol AND u.rn = w.rn + 1)"
    " SELECT w.symbol, u.time, w.rn, CASE WHEN neg > 1e-12 THEN 100 - 100 / (1 + pos / neg) WHEN pos > 1e-12 THEN 100.0 ELSE 50.0 END AS rsi FROM w JOIN u USING (symbol, rn)",
    "rsi",
)(lambda s, d: indicators.rsi(h1(s, d)))
SPREAD = f"{ROWS}, i AS (SELECT *, list(close) OVER {_over(14)} AS v, avg(close) OVER {_over(14)} AS m FROM r), j AS (SELECT *, sqrt(list_sum(list_transform(v[1:13], lambda x: (x - m) * (x - m)))) AS deviation FROM i WHERE rn >= 13)"
query("stdev_14", f"{SPREAD} SELECT symbol, time, rn, deviation FROM j", "deviation")(lambda s, d: indicators.spread_deviation(h1(s, d)))
query("true_stdev_14", f"{ROWS}, i AS (SELECT *, stddev_pop(close) OVER {_over(14)} AS deviation FROM r) SELECT symbol, time, rn, deviation FROM i WHERE rn >= 13", "deviation")(lambda s, d: indicators.standard_deviation(h1(s, d)))
query("bollinger_14", f"{SPREAD} SELECT symbol, time, rn, m AS middle, m + 2 * deviation AS upper, m - 2 * deviation AS lower FROM j", "middle upper lower")(lambda s, d: indicators.bollinger(h1(s, d)))
query(
    "gk_volatility_14",
    f"{ROWS}, g AS (SELECT symbol, time, rn, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS v FROM r), i AS (SELECT *, avg(v) OVER {_over(14)} AS m FROM g)"
    " SELECT symbol, time, rn, CASE WHEN m >= 0 THEN sqrt(m) * sqrt(14.0) END AS volatility FROM i WHERE rn >= 13",
    "volatility",
)(lambda s, d: indicators.garman_klass(h1(s, d), ieee=True))
query("body_range_ratio", f"{BARS} SELECT symbol, time, CASE WHEN high = low THEN 0 ELSE abs(open - close) / (high - low) END AS ratio FROM bars", "ratio")(lambda s, d: indicators.body_range_ratio(h1(s, d)))
ANCHORED = f"{ROWS}, i AS (SELECT symbol, time, rn, n, list(close) OVER {_over(L)} AS v, list(time) OVER {_over(L)} AS ts, list(open) OVER {_over(L)} AS o FROM r), a AS (SELECT * FROM i WHERE rn >= {L - 1} AND (rn - {L - 1}) % {STRIDE} = 0)"
query(
    "clip_zscore_last",
    f"{ANCHORED}, u AS (SELECT symbol, rn, unnest(v) AS x, v[{L}] AS last FROM a), q AS (SELECT symbol, rn, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM u GROUP BY 1, 2),"
    " z AS (SELECT symbol, rn, avg(greatest(least(x, hi), lo)) AS m, stddev_pop(greatest(least(x, hi), lo)) AS s, first(greatest(least(last, hi), lo)) AS e FROM u JOIN q USING (symbol, rn) GROUP BY 1, 2)"
    " SELECT symbol, rn, CASE WHEN s > 1e-12 THEN (e - m) / s ELSE 0 END AS zscore FROM z",
    "zscore",
)(lambda s, d: indicators.clipped_zscore_last(h1_windows(s, d, "close")).select("symbol", "rn", "zscore"))
query(
    "layer_norm",
    f"{ANCHORED}, u AS (SELECT symbol, rn, unnest(v) AS x, unnest(range({L})) AS i FROM a) SELECT symbol, rn, i::INT AS i, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 0.001) AS x FROM u WINDOW w AS (PARTITION BY symbol, rn)",
    "x",
)(lambda s, d: indicators.layer_norm(h1_windows(s, d, "close")).select("symbol", "rn", F.posexplode("close").alias("i", "x")))

# Windows and targets

_ALL = ("time", *bar_source.FEATURES)
query(
    "seq_windows",
    f"{ROWS}, a AS (SELECT symbol, rn, time AS end_time FROM r WHERE rn >= {L - 1} AND (rn - {L - 1}) % {STRIDE} = 0)"
    f" SELECT a.symbol, a.rn, end_time, (r.rn - a.rn + {L - 1})::INT AS i, {', '.join('r.' + c for c in _ALL)} FROM a JOIN r ON r.symbol = a.symbol AND r.rn BETWEEN a.rn - {L - 1} AND a.rn",
    " ".join(bar_source.FEATURES),
)(lambda s, d: h1_windows(s, d).select("symbol", "rn", "end_time", F.posexplode(F.arrays_zip(*_ALL)).alias("i", "b")).select("symbol", "rn", "end_time", "i", "b.*"))
query(
    "window_counts",
    f"{BARS}, c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, n, greatest(0, floor((n - {L}) / {STRIDE}) + 1)::BIGINT AS n_windows, greatest(0, floor((n - {T} + 1 - {L}) / {STRIDE}) + 1)::BIGINT AS n_targets FROM c",
)(lambda s, d: windows.counts(h1(s, d), L, STRIDE, T))
TARGET_REALS = "target_highest target_lowest target_value entry"
query("targets_raw", f"{TARGETS} SELECT * FROM raw", TARGET_REALS)(lambda s, d: windows.targets(h1(s, d), L, STRIDE, windows.TimeTarget(T, "raw_difference")))
query("targets_points", f"{TARGETS} SELECT * FROM points", TARGET_REALS)(point_targets)
_F = f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND {T} FOLLOWING)"
query(
    "targets_prices",
    f"{ROWS}, i AS (SELECT symbol, rn, n, " + ", ".join(f"list({c}) OVER {_F} AS {c}s" for c in ("high", "low", "close")) + f" FROM r) SELECT symbol, rn, "
    + ", ".join(f"{c}s[{k + 1}] AS target_{c}__{k}" for c in ("high", "low", "close") for k in range(T))
    + f" FROM i WHERE rn >= {L - 1} AND (rn - {L - 1}) % {STRIDE} = 0 AND rn + {T} < n",
    " ".join(f"target_{c}__{k}" for c in ("high", "low", "close") for k in range(T)),
)(lambda s, d: windows.flatten(windows.targets(h1(s, d), L, STRIDE, windows.TimeTarget(T, "prices")), ("target_high", "target_low", "target_close"), T).drop("end_time"))
query("window_tail_slice", f"{ANCHORED} SELECT symbol, rn, v[-3] AS close__0, v[-2] AS close__1, v[-1] AS close__2 FROM a", "close__0 close__1 close__2")(
    lambda s, d: windows.flatten(windows.tail(h1_windows(s, d, "close"), 3), ("close",), 3).select("symbol", "rn", "close__0", "close__1", "close__2")
)
query("end_times", f"{ANCHORED} SELECT symbol, rn, ts[-1] AS end_time FROM a")(lambda s, d: windows.end_times(h1_windows(s, d, "time").drop("end_time")).select("symbol", "rn", "end_time"))
query("common_length", f"{ANCHORED} SELECT symbol, rn, {L - 4}::INT AS size, v[{L - 4}] AS last FROM a", "last")(
    lambda s, d: windows.common_length(windows.tail(h1_windows(s, d, "time", "close"), L - 4, ("time",)), ("time", "close")).select("symbol", "rn", F.size("close").alias("size"), F.element_at("close", -1).alias("last"))
)
query("flatten_roundtrip", f"{ANCHORED} SELECT symbol, rn, list_sum(v) AS total, len(v)::INT AS size FROM a", "total")(
    lambda s, d: windows.unflatten(windows.flatten(h1_windows(s, d, "close"), ("close",), L), ("close",), L).select(
        "symbol", "rn", F.aggregate("close", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("close").alias("size")
    )
)
query("feature_stack", f"{ANCHORED} SELECT symbol, rn, {2 * L}::INT AS size, v[1] AS first, o[-1] AS last FROM a", "first last")(
    lambda s, d: windows.stacked(h1_windows(s, d, "open", "close"), ("open", "close")).select("symbol", "rn", F.size("vector").alias("size"), F.get("vector", F.lit(0)).alias("first"), F.element_at("vector", -1).alias("last"))
)
query("window_shards", f"{ANCHORED} SELECT symbol, rn, (ntile(4) OVER (PARTITION BY symbol ORDER BY rn) - 1)::INT AS shard FROM a")(lambda s, d: windows.shards(h1_windows(s, d, "time"), 4).select("symbol", "rn", "shard"))
query("aux_filter", f"{SCORED} SELECT * FROM scored WHERE predicted = 1")(lambda s, d: windows.keep_class(scored(s, d), "predicted", 1))
query("exclude_class", f"{SCORED} SELECT * FROM scored WHERE label <> 2")(lambda s, d: windows.without_class(scored(s, d), "label", 2))
query("take_batches", f"{SCORED} SELECT * FROM scored ORDER BY event_id LIMIT 192")(lambda s, d: windows.take_batches(scored(s, d), 3, 64, "event_id"))

# Statistics

_P = statistics.PERCENTILES
query(
    "target_quantiles",
    f"{TARGETS}, u AS (UNPIVOT (SELECT symbol, target_highest, target_lowest, target_value FROM points) ON target_highest, target_lowest, target_value INTO NAME name VALUE x) SELECT symbol, name, "
    + ", ".join(f"quantile_cont(x, {p / 100}) AS p{p}" for p in _P) + " FROM u GROUP BY 1, 2",
    " ".join(f"p{p}" for p in _P),
)(lambda s, d: statistics.quantiles(point_targets(s, d), ("target_highest", "target_lowest", "target_value")))
query(
    "target_compare_counts",
    f"{TARGETS} SELECT symbol, count(*) FILTER (target_highest > target_lowest) AS highest_gt_lowest, count(*) FILTER (target_lowest > target_highest) AS lowest_gt_highest, count(*) FILTER (target_highest = target_lowest) AS equal, count(*) AS total FROM points GROUP BY 1",
)(lambda s, d: statistics.compare_counts(point_targets(s, d)))
query("min_target_points", f"{LABELS} SELECT * FROM least")(lambda s, d: statistics.min_target_points(point_targets(s, d)))
query("labelled_windows", f"{LABELS} SELECT symbol, rn, label FROM labelled")(lambda s, d: labelled(s, d).select("symbol", "rn", "label"))
query("label_distribution", f'{LABELS} SELECT label, count(*) AS "rows", 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM labelled GROUP BY 1', "percent")(lambda s, d: statistics.distribution(labelled(s, d)))
query("class_weights", f'{LABELS}, c AS (SELECT label, count(*) AS "rows" FROM labelled GROUP BY 1) SELECT label, "rows", sum("rows") OVER () / (count(*) OVER () * "rows") AS weight FROM c', "weight")(lambda s, d: statistics.class_weights(labelled(s, d)))
query(
    "output_bias",
    f"{LABELS}, c AS (SELECT i AS label, greatest(count(l.label) / (SELECT count(*) FROM labelled), {statistics.TINY}) AS share FROM range(4) t(i) LEFT JOIN labelled l ON l.label = i GROUP BY 1) SELECT label, ln(share / sum(share) OVER ()) AS bias FROM c",
    "bias",
)(lambda s, d: statistics.output_bias(labelled(s, d), 4))
query(
    "label_remap",
    f"{SCORED}, k AS (SELECT DISTINCT label * 2 + 1 AS label FROM scored WHERE event_id % 5 > 0 UNION SELECT DISTINCT label * 2 + 1 FROM scored WHERE event_id % 5 = 0) SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS class_id FROM k",
)(lambda s, d: (lambda x: statistics.dense_ids(x.filter("event_id % 5 > 0"), x.filter("event_id % 5 = 0")))(scored(s, d).withColumn("label", F.col("label") * 2 + 1)))
query("one_hot_ids", f"{SCORED} SELECT event_id, label AS class_id FROM scored")(
    lambda s, d: scored(s, d).withColumn("y", F.array(*(F.when(F.col("label") == i, 1.0).otherwise(0.0) for i in range(3)))).select("event_id", statistics.class_id("y").alias("class_id"))
)
query(
    "anova_f",
    f"{LABELS}, u AS (UNPIVOT (SELECT label, entry, target_value, rn::DOUBLE AS rn FROM labelled) ON entry, target_value, rn INTO NAME feature VALUE x),"
    " g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM u GROUP BY 1, 2 HAVING count(*) > 1),"
    " a AS (SELECT feature, sum(n * m) / sum(n) AS mm, sum(n) AS nn, count(*) AS k, sum(ss) AS w FROM g GROUP BY 1),"
    " f AS (SELECT feature, (sum(n * (m - mm) ** 2) / (any_value(k) - 1)) / (any_value(w) / (any_value(nn) - any_value(k))) AS f FROM g JOIN a USING (feature) GROUP BY 1)"
    " SELECT feature, f, f / max(f) OVER () AS importance FROM f",
    "f importance",
)(lambda s, d: statistics.anova_f(labelled(s, d), ("entry", "target_value", "rn")))
#: The first four fifths of each symbol's bars.
TRAINING = "rn < n - floor(n * 0.2)"
query(
    "zscore_train_stats",
    f"{ROWS}, t AS (SELECT avg(close) AS m, stddev_pop(close) AS s FROM r WHERE rn < n - trunc(n * 0.2)) SELECT symbol, rn, (close - m) / (s + 1e-8) AS close FROM r, t",
    "close",
)(lambda s, d: (lambda x: statistics.zscored(x, x.filter(TRAINING), ("close",)).drop("n"))(numbered(h1(s, d)).select("symbol", "rn", "n", "close")))
query(
    "median_impute",
    f"{ROWS}, x AS (SELECT symbol, rn, n, CASE WHEN rn % 11 = 0 THEN NULL ELSE close END AS close FROM r), t AS (SELECT quantile_cont(close, 0.5) AS m FROM x WHERE rn < n - trunc(n * 0.2)) SELECT symbol, rn, coalesce(close, m) AS close FROM x, t",
    "close",
)(
    lambda s, d: (lambda x: statistics.imputed(x, x.filter(TRAINING), ("close",)).drop("n"))(
        numbered(h1(s, d)).select(
            "symbol", "rn", "n", F.when(F.col("rn") % 11 == 0, F.when(F.col("rn") % 22 == 0, F.lit(float("nan"))).when(F.col("rn") % 33 == 0, F.lit(float("inf")))).otherwise(F.col("close")).alias("close")
        )
    )
)
query(
    "dataset_eligibility",
    f"{LABELS}, t AS (SELECT symbol, count(*) AS sequences, count(*) FILTER (label = 0) AS buy, count(*) FILTER (label = 1) AS sell, avg(entry * entry) - avg(entry) ** 2 AS variance FROM labelled GROUP BY 1), u AS (SELECT *, greatest(buy, sell) / greatest(1, least(buy, sell)) AS ratio FROM t),"
    " v AS (SELECT *, CASE WHEN buy + sell <= 80 THEN 'too few signals' WHEN sequences <= 100 THEN 'too few sequences' WHEN buy = 0 OR sell = 0 THEN 'one class only' WHEN ratio >= 1.3 THEN 'unbalanced' WHEN variance <= 1e-10 THEN 'no variance' ELSE 'ok' END AS reason FROM u)"
    " SELECT symbol, sequences, buy, sell, ratio, variance, reason, reason = 'ok' AS eligible FROM v",
    "ratio variance",
)(lambda s, d: statistics.eligibility(labelled(s, d), ("entry",), min_signals=80, min_sequences=100, max_ratio=1.3))

# Evaluation

query("confusion_matrix", f"{SCORED} SELECT label, " + ", ".join(f"count(*) FILTER (predicted = {c}) AS pred_{c}" for c in range(3)) + " FROM scored GROUP BY 1")(lambda s, d: evaluation.confusion(scored(s, d)))


def _metric_sql(divide: Callable[[str, str], str], classes: tuple[int, ...]) -> str:
    out = [f"{divide('count(*) FILTER (label = predicted)', 'count(*)')} AS accuracy"]
    for c in classes:
        both, p, y = (f"count(*) FILTER ({x})" for x in (f"label = {c} AND predicted = {c}", f"predicted = {c}", f"label = {c}"))
        a, b = divide(both, p), divide(both, y)
        n = evaluation.NAMES[c]
        out += [f"{a} AS precision_{n}", f"{b} AS recall_{n}", f"{divide(f'2 * {a} * {b}', f'({a} + {b})')} AS f1_{n}"]
    return f"{SCORED} SELECT symbol, {', '.join(out)} FROM scored GROUP BY symbol"


_SAFE = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
_EPS = lambda a, b: f"({a} / ({b} + 1e-9))"
_REALS = lambda cs: " ".join(["accuracy", *(f"{m}_{evaluation.NAMES[c]}" for c in cs for m in ("precision", "recall", "f1"))])
METRICS = _metric_sql(_SAFE, (0, 1, 2))
query("class_metrics", METRICS, _REALS((0, 1, 2)))(lambda s, d: evaluation.class_metrics(scored(s, d), ("symbol",), hold=True))
query("class_metrics_eps", _metric_sql(_EPS, (0, 1)), _REALS((0, 1)))(lambda s, d: evaluation.class_metrics(scored(s, d), ("symbol",), epsilon=1e-9))
query(
    "macro_metrics",
    f"WITH m AS (WITH {METRICS}) SELECT symbol, " + ", ".join("(" + " + ".join(f"{n}_{c}" for c in ("buy", "sell", "hold")) + f") / 3 AS macro_{n}" for n in ("precision", "recall", "f1")) + " FROM m",
    "macro_precision macro_recall macro_f1",
)(lambda s, d: evaluation.macro(evaluation.class_metrics(scored(s, d), ("symbol",), hold=True)).select("symbol", "macro_precision", "macro_recall", "macro_f1"))
query(
    "no_train_metrics",
    "WITH m AS (WITH " + METRICS.replace("AS predicted FROM events)", "AS other FROM events), shown AS (SELECT *, label AS predicted FROM scored)").replace("FROM scored GROUP BY symbol", "FROM shown GROUP BY symbol")
    + ") SELECT symbol, accuracy, precision_buy, precision_sell, recall_buy, recall_sell FROM m",
)(
    lambda s, d: evaluation.class_metrics(training.no_train(scored(s, d).drop("predicted").withColumn("direction", F.col("label"))), ("symbol",)).select("symbol", "accuracy", "precision_buy", "precision_sell", "recall_buy", "recall_sell")
)
_MODELS = "SELECT symbol, 'm' || k AS model_id, k, precision_buy * k / 2 AS precision_buy, recall_buy, precision_sell, recall_sell * k / 3 AS recall_sell, 1.0 + 0.1 * k AS val_loss, 1.2 AS train_loss FROM m, range(1, 4) t(k)"
_GATED = (
    f"WITH m AS (WITH {METRICS}), c AS ({_MODELS}), g AS (SELECT *, abs(val_loss - train_loss) / greatest(abs(train_loss), 1e-8) AS gap FROM c),"
    " v AS (SELECT *, precision_buy > 0.3 AND recall_buy > 0.3 AS buy_valid, precision_sell > 0.3 AND recall_sell > 0.3 AS sell_valid, gap <= 0.2 AS gap_valid FROM g), w AS (SELECT *, (buy_valid OR sell_valid) AND gap_valid AS valid FROM v)"
)


def models(spark, sf_dir):
    k = F.explode(F.array(*map(F.lit, range(1, 4)))).alias("k")
    base = evaluation.class_metrics(scored(spark, sf_dir), ("symbol",), hold=True).select("*", k)
    rows = base.select(
        "symbol", F.concat(F.lit("m"), F.col("k")).alias("model_id"), "k", (F.col("precision_buy") * F.col("k") / 2).alias("precision_buy"), "recall_buy", "precision_sell",
        (F.col("recall_sell") * F.col("k") / 3).alias("recall_sell"), (F.lit(1.0) + 0.1 * F.col("k")).alias("val_loss"), F.lit(1.2).alias("train_loss"),
    )
    return evaluation.gate(rows, 0.3, 0.3, 0.2)


query("quality_gate", f"{_GATED} SELECT symbol, model_id, gap, buy_valid, sell_valid, gap_valid, valid, CASE WHEN gap_valid THEN 'PASS' ELSE 'FAIL' END AS gap_reason FROM w", "gap")(
    lambda s, d: models(s, d).select("symbol", "model_id", "gap", "buy_valid", "sell_valid", "gap_valid", "valid", F.substring("reason_gap", 1, 4).alias("gap_reason"))
)
query("rank_models", f"{_GATED} SELECT symbol, model_id, row_number() OVER (PARTITION BY symbol ORDER BY precision_buy DESC, recall_buy DESC, precision_sell DESC, recall_sell DESC, model_id)::INT AS rank FROM w WHERE valid")(
    lambda s, d: evaluation.rank_models(models(s, d)).select("symbol", "model_id", "rank")
)
query(
    "overfit_probe",
    f"WITH m AS (WITH {METRICS}) SELECT symbol, least(" + ", ".join(f"{n}_{c}" for n in ("precision", "recall") for c in ("buy", "sell", "hold")) + ") >= 0.25 AS scores_pass, accuracy >= 0.3 AS accuracy_pass FROM m",
)(lambda s, d: evaluation.overfit_probe(evaluation.class_metrics(scored(s, d), ("symbol",), hold=True), least=0.25, least_accuracy=0.3))

# Ensembles and signals

_COUNTED = f"{VOTES}, k AS (SELECT row_id, prediction, count(*) AS c, min(priority) AS p FROM votes GROUP BY 1, 2), x AS (SELECT *, max(c) OVER (PARTITION BY row_id) AS top FROM k)"
query("vote_unanimous", f"{VOTES} SELECT row_id, (CASE WHEN count(DISTINCT prediction) = 1 THEN min(prediction) ELSE 2 END)::INT AS prediction FROM votes GROUP BY 1")(lambda s, d: ensemble.vote(votes(s, d), "unanimous", components=4))
query("vote_majority", f"{_COUNTED} SELECT row_id, (CASE WHEN count(*) = 1 THEN min(prediction) ELSE 2 END)::INT AS prediction FROM x WHERE c = top GROUP BY 1")(lambda s, d: ensemble.vote(votes(s, d), "majority", components=4))
query("vote_priority", f"{_COUNTED} SELECT row_id, min_by(prediction, p)::INT AS prediction FROM x WHERE c = top GROUP BY 1")(lambda s, d: ensemble.vote(votes(s, d), "priority_tiebreak", components=4))
query(
    "vote_no_rows",
    f"{VOTES}, k AS (SELECT row_id, prediction, count(*) AS c FROM votes WHERE prediction <> 2 GROUP BY 1, 2), x AS (SELECT *, max(c) OVER (PARTITION BY row_id) AS top FROM k),"
    " y AS (SELECT row_id, CASE WHEN count(*) = 1 THEN min(prediction) ELSE 2 END AS p FROM x WHERE c = top GROUP BY 1) SELECT event_id AS row_id, coalesce(p, 2)::INT AS prediction FROM events LEFT JOIN y ON row_id = event_id",
)(lambda s, d: (lambda v: ensemble.vote(v.filter("prediction <> 2"), "majority", rows_of=v))(votes(s, d)))
query("filter_override", f"{VOTES} SELECT a.row_id, (CASE WHEN b.prediction = 1 THEN a.prediction ELSE 2 END)::INT AS prediction FROM votes a JOIN votes b USING (row_id) WHERE a.model = 1 AND b.model = 2")(
    lambda s, d: (lambda v: ensemble.filter_override(v.filter("model = 1"), v.filter("model = 2"), 1))(votes(s, d))
)
query(
    "signals",
    f"{_GATED}, {LABELS}, b AS (SELECT symbol, buy_valid, sell_valid FROM w WHERE k = 2) SELECT symbol, end_time AS timestamp, CASE label WHEN 0 THEN 'BUY' ELSE 'SELL' END AS signal_type, entry AS price FROM labelled JOIN b USING (symbol) WHERE (label = 0 AND buy_valid) OR (label = 1 AND sell_valid)",
    "price",
)(
    lambda s, d: ensemble.signals(
        labelled(s, d).select("symbol", F.array("end_time").alias("time"), F.array("entry").alias("close"), F.col("label").alias("prediction")), models(s, d).filter("k = 2")
    )
)


_GRID = (
    f"{LABELS}, m AS (SELECT * FROM (VALUES ('fixed_sl_tp', 1.0, 0.5, NULL, NULL), ('fixed_sl_tp', 1.0, 1.0, NULL, NULL), ('risk_reward', 1.0, NULL, 3.0, NULL), ('time_stop', 1.0, 1.0, NULL, 240)) t(manager, stop, take, reward_ratio, max_minutes)),"
    " z AS (SELECT * FROM (VALUES ('percentage_risk', 0.02, 0.01, NULL, NULL, 1.0), ('martingale_lot_size', NULL, 0.01, 1.5, 5, NULL), ('anti_martingale_lot_size', NULL, 0.01, 1.5, 5, NULL)) t(sizer, risk, lots, factor, steps, max_lots))"
    " SELECT symbol, manager, (min_points * stop)::DOUBLE AS stop_points, (min_points * take)::DOUBLE AS take_points, reward_ratio::DOUBLE AS reward_ratio, max_minutes::INT AS max_minutes, sizer, risk::DOUBLE AS risk, lots::DOUBLE AS lots, factor::DOUBLE AS factor, steps::INT AS steps, max_lots::DOUBLE AS max_lots FROM least, m, z"
)
query("backtest_grid", _GRID, "stop_points take_points reward_ratio risk lots factor max_lots")(lambda s, d: ensemble.backtest_grid(statistics.min_target_points(point_targets(s, d))))
query(
    "ensemble_metadata",
    f"{_GATED} SELECT symbol AS ensemble_id, avg(precision_buy) AS precision_buy, avg(recall_buy) AS recall_buy, 0.0::DOUBLE AS precision_sell, 0.0::DOUBLE AS recall_sell, max(k * 10)::INT AS sequence_length, count(*) AS components, symbol FROM w GROUP BY symbol",
    "precision_buy recall_buy",
)(lambda s, d: ensemble.ensemble_entry(models(s, d).withColumns({"ensemble_id": F.col("symbol"), "sequence_length": F.col("k") * 10}), "buy_only"))

# Clusters

WIDTH = 64  # of the embeddings table
CENTROIDS = [(i, [float((i * 7 + j * 3) % 5 - 2) / 10 for j in range(WIDTH)]) for i in range(5)] + [(5, [90.0] * WIDTH)]
_C = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}::DOUBLE[])" for i, v in CENTROIDS) + ") t(cluster, w))"
_K = f"{_C}, p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v[i] - w[i]) ** 2)) AS distance FROM p, c), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


query("kmeans_assign", f"{_K} SELECT vec_id, cluster, distance FROM a", "distance")(lambda s, d: clustering.assign(vectors(s, d), CENTROIDS).select("vec_id", "cluster", "distance"))
query(
    "kmeans_step",
    f"{_K} SELECT c.cluster, count(vec_id) AS members, " + ", ".join(f"coalesce(avg(v[{i + 1}]), any_value(w[{i + 1}])) AS x{i}" for i in range(WIDTH)) + " FROM c LEFT JOIN a USING (cluster) GROUP BY 1",
    " ".join(f"x{i}" for i in range(WIDTH)),
)(lambda s, d: clustering.step(vectors(s, d), CENTROIDS).select("cluster", "members", *(F.get("vector", F.lit(i)).alias(f"x{i}") for i in range(WIDTH))))
query("kmeans_loss", f"{_K} SELECT avg(distance) AS loss FROM a", "loss")(lambda s, d: clustering.loss(vectors(s, d), CENTROIDS))


@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    points = vectors(spark, sf_dir)
    model = clustering.fit(points, clustering.default_clusters(points.count()))
    return clustering.predict(model, points).select("vec_id", F.col("prediction").alias("cluster"))


# Training and data sets

query("ordered_split", f"{SCORED} SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 >= count(*) OVER () - trunc(count(*) OVER () * 0.2) AS validation FROM scored")(
    lambda s, d: training.ordered_split(scored(s, d), ("event_id",)).select("event_id", "validation")
)
query("sampled_weights", f"{SCORED}, c AS (SELECT label, count(*) AS n FROM scored GROUP BY 1), w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c) SELECT event_id, weight FROM scored JOIN w USING (label)", "weight")(
    lambda s, d: training.sampled(scored(s, d), "weights").select("event_id", "weight")
)
_SIZED = "{s}, c AS (SELECT label, count(*) AS n FROM scored GROUP BY 1) SELECT label, (SELECT {f}(n) FROM c) AS total FROM c"
for _name, _how, _fold in (("oversample", "over", "max"), ("undersample", "under", "min"), ("over_under_sample", "over_under", "max")):
    query(f"{_name}_sizes", _SIZED.format(s=SCORED, f=_fold))(lambda s, d, how=_how: training.sampled(scored(s, d), how, keys=("event_id",)).groupBy("label").agg(F.count("*").alias("total")))
    query(
        _name,
        f"{SCORED}, k AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5('44{{\"event_id\":' || event_id || '}}'), event_id) - 1 AS place FROM scored),"
        f" w AS (SELECT *, (SELECT {_fold}(n) FROM k) AS want FROM k) SELECT symbol, event_id, label, predicted FROM (SELECT *, unnest(range(want // n + CASE WHEN place < want % n THEN 1 ELSE 0 END)) FROM w)",
    )(lambda s, d, how=_how: training.sampled(scored(s, d), how, keys=("event_id",)))
query("resampled_weights", f"{SCORED}, c AS (SELECT label, count(*) AS n FROM scored WHERE NOT (symbol = 'click' AND label = 1) GROUP BY 1), u AS (SELECT label, (SELECT min(n) FROM c) AS n FROM c) SELECT label, n AS \"rows\", sum(n) OVER () / (count(*) OVER () * n) AS weight FROM u", "weight")(
    lambda s, d: training.resampled(scored(s, d).filter("not (symbol = 'click' and label = 1)"), "undersample", keys=("event_id",)).groupBy("label").agg(F.count("*").alias("rows"), F.max("weight").alias("weight"))
)
query("iso_times", f"{BARS} SELECT symbol, time, strftime(make_timestamp(time * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM bars")(lambda s, d: h1(s, d).select("symbol", "time", resample.isoformat("time").alias("iso")))


@query("smote_sample")
def smote_sample(spark, sf_dir):
    own = vectors(spark, sf_dir)
    width = max((len(r["vector"]) for r in own.head(1)), default=0)
    return training.smote(own).select("label", *(F.round(F.get("vector", F.lit(i)), 6).alias(f"x{i}") for i in range(width)))


def _binary(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("label", F.col("label") % 2)


query("gbt_fit")(lambda s, d: training.predict(training.fit_trees(_binary(s, d), 2), _binary(s, d)).select("vec_id", "label", "predicted"))
query("forest_fit")(lambda s, d: training.predict(training.fit_trees(vectors(s, d), 3), vectors(s, d)).select("vec_id", "label", "predicted"))
query("frame_metadata", f"""{BARS} SELECT symbol, min(time) AS start_time, max(time) AS end_time, count(*) AS "rows", '{datasets.canonical({"length": L, "stride": STRIDE})}' AS options FROM bars GROUP BY 1""")(
    lambda s, d: datasets.metadata(h1(s, d), length=L, stride=STRIDE)
)
_MANIFEST = "mf AS (SELECT event_type AS symbol, event_id % 9 AS version, CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'eval' END AS split, 'd' || (event_id % 3) AS digest FROM events)"


def manifest(spark, sf_dir):
    i = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), (i % 9).alias("version"), F.when(i % 2 == 0, "train").otherwise("eval").alias("split"), F.concat(F.lit("d"), i % 3).alias("digest"))


query("version_next", f"{_MANIFEST} SELECT symbol, max(version) + 1 AS next_version FROM mf GROUP BY 1")(lambda s, d: datasets.next_version(manifest(s, d)))
query("version_match", f"{_MANIFEST}, k AS (SELECT symbol, version FROM mf WHERE digest = 'd1' GROUP BY 1, 2 HAVING count(DISTINCT split) = 2) SELECT symbol, max(version) AS version FROM k GROUP BY 1")(
    lambda s, d: datasets.matching_version(manifest(s, d), "d1")
)
query(
    "flagship",
    f"{TARGETS}, s AS (SELECT symbol, rn, avg(close) OVER {_over(12)} AS sma_12 FROM r) SELECT symbol, rn, end_time, target_highest, target_lowest, target_value, entry, sma_12 FROM raw JOIN s USING (symbol, rn)",
    TARGET_REALS + " sma_12",
)(flagship)
