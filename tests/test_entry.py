import json
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from barloom.plans import catalog
from barloom.sources import bars as bar_source
from barloom.streaming.bars import stream_bars

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMOKE = entry.SMOKE_DIR


def test_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(tmp_path):
    """The entry module works where the corpus operators aren't there."""
    for name in ("__spark_entry__.py", "barloom"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name)
    code = "import sys; sys.modules['barloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.strip().endswith("[]"), said.stderr


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke tables")
def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    show = lambda rows: sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)
    for name in catalog.ORACLE:
        df = catalog.QUERIES[name](spark, SMOKE)
        names = sorted(df.columns)
        want = con.sql(catalog.ORACLE[name]).select(*names).fetchall()
        assert show(tuple(r[c] for c in names) for r in df.collect()) == show(want), name


def test_volatility_of_odd_prices_against_sql(spark, tmp_path):
    """One odd bar a symbol; the smoke tables have no price of 0."""
    import datetime as dt

    duckdb = pytest.importorskip("duckdb")
    nan, inf = float("nan"), float("inf")
    odd = {"low": [1, 0, 2], "open": [0, 1], "close": [1, 0], "zero": [0], "minus": [1, -0.0, 2], "wide": [-1, 2], "below": [-3, -1, -2]}
    odd |= {"null": [None], "first": [None, 1, 2], "last": [1, 2, None], "nan": [1, nan, 2], "inf": [1, inf, 2], "plain": [1]}
    rows = []
    for symbol, values in odd.items():
        for hour in range(36):
            for i, v in enumerate(values if hour == 15 else [hour % 5 + 1, hour % 7 + 2, hour % 3 + 1]):
                rows.append((len(rows), dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=i), symbol, None if v is None else float(v)))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    names = ["symbol", "rn", "time", "volatility"]
    want = {tuple(r[:3]): str(r[3]) for r in con.sql(catalog.ORACLE["gk_volatility_14"]).select(*names).fetchall()}
    got = {tuple(r[c] for c in names[:3]): str(r["volatility"]) for r in catalog.QUERIES["gk_volatility_14"](spark, str(tmp_path)).collect()}
    assert got == want and {"inf", "nan"} < set(want.values()) and len(want) == 23 * len(odd)


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke tables")
def test_whole_embeddings(spark):
    """Queries without SQL take every value of a vector."""
    width = len(spark.read.parquet(f"{SMOKE}/embeddings.parquet").first()["embedding"])
    assert width == 64 and len(catalog.vectors(spark, SMOKE).first()["vector"]) == width
    assert catalog.QUERIES["smote_sample"](spark, SMOKE).columns == ["label", *(f"x{i}" for i in range(width))]


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke tables")
def test_whole_models(spark, monkeypatch):
    """Models are fitted with the operators' own defaults."""
    asked = []

    def held(*args, **params):
        asked.append((*args[1:], params))
        raise StopIteration

    monkeypatch.setattr(catalog.clustering, "fit", held)
    monkeypatch.setattr(catalog.training, "fit_trees", held)
    for name in ("kmeans_fit", "gbt_fit", "forest_fit"):
        with pytest.raises(StopIteration):
            catalog.QUERIES[name](spark, SMOKE)
    assert asked == [(500, {}), (2, {}), (3, {})]


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke tables")
def test_plans_prune(spark):
    """Scans read the columns they need, and votes shuffle once."""
    plan = catalog.QUERIES["bars_h1"](spark, SMOKE)._jdf.queryExecution().toString()
    assert "props" not in plan.split("Physical Plan")[1] and "user_id" not in plan.split("Physical Plan")[1]


def test_stream(spark, tmp_path):
    rows = [{"symbol": "s", "ts": f"2024-01-01T0{h}:{m:02d}:00Z", "value": float(h * 60 + m), "tick_id": h * 60 + m} for h in range(4) for m in range(0, 60, 7)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    ticks = spark.readStream.schema("symbol string, ts timestamp, value double, tick_id long").json(str(tmp_path / "in"))
    q = stream_bars(ticks).writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["time"] - 1704067200: (r["open"], r["close"], r["tick_volume"]) for r in spark.table("bars_out").collect()}
    assert got == {3600 * h: (h * 60.0, h * 60 + 56.0, 9.0) for h in range(3)}


def test_reading_a_symbol(spark, tmp_path):
    import datetime as dt

    path = bar_source.raw_path(str(tmp_path), "mt5", "fx", " EURUSD ")
    rows = [(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), *[1.0] * 7, "more")]
    spark.createDataFrame(rows, "time timestamp, " + ", ".join(f"{c} double" for c in bar_source.FEATURES) + ", more string").write.parquet(path)
    got = bar_source.read_symbol(spark, str(tmp_path), "mt5", "fx", "EURUSD").first()
    assert got["time"] == 1704067200 and got["symbol"] == "EURUSD"
    with pytest.raises(ValueError, match="close, high"):
        bar_source.check_columns(spark.createDataFrame([(1,)], "time int"))
    with pytest.raises(ValueError):
        bar_source.raw_path("r", "a", "b", " ")
