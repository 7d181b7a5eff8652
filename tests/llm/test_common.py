import os
import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from barloom.llm import common, toxicity


def anonymous_mb(pid):
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
@pytest.mark.parametrize("way", ["map_batches", "map_arrow", "keep_clean"])
def test_idle_workers_give_memory_back(spark, way, tmp_path, monkeypatch):
    """What a task has freed doesn't stay with its worker while other stages run."""
    to = str(tmp_path / "pid")

    def use():
        rows = [bytes(2000) for _ in range(75_000)]  # 150 MB of malloc's
        sys.barloom_pin = bytes(3000)  # above them, so that the heap can't shrink by itself
        del rows
        Path(to).write_text(str(os.getpid()))

    def make():
        use()
        return lambda rows: {"doc_id": rows.column("doc_id")}

    def run(batches):
        use()
        yield from batches

    def scorer(model):
        def make_score():
            use()
            return lambda text: 0.0

        return make_score

    docs = spark.createDataFrame([(1, "one text")], "doc_id long, text string").coalesce(1)
    if way == "map_batches":
        out = common.map_batches(docs.select("doc_id"), make, "doc_id long")
    elif way == "map_arrow":
        out = common.map_arrow(docs, run, docs.schema)
    else:
        monkeypatch.setattr(toxicity, "_scorer", scorer)
        out = toxicity.keep_clean(docs, None)
    assert out.select("doc_id").collect() == [(1,)]
    assert anonymous_mb(int(Path(to).read_text())) < 100


def test_slices_keep_all_rows(spark, monkeypatch):
    """Batches beyond one slice, and empty ones, lose or repeat no row."""
    monkeypatch.setattr(toxicity, "_scorer", lambda model: lambda: lambda text: 0.9 if text == "bad" else 0.1)
    n = 2 * toxicity.SLICE + 7
    docs = spark.createDataFrame([(i, "bad" if i % 5 == 0 else None if i % 5 == 1 else "good") for i in range(n)], "doc_id long, text string").coalesce(1)
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, None).collect()) == [i for i in range(n) if i % 5]
    assert toxicity.keep_clean(docs.limit(0), None).collect() == []


def test_held_is_cleared():
    common.held["key"] = pa.array([1])
    common.give_back()
    assert not common.held
