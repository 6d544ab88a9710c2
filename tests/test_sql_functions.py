"""Table functions of SQL against the operators, with batches much shorter than the signals."""

from __future__ import annotations

import numpy as np
import pytest

from resonarium.operators import directed, spectral
from resonarium.plans import sql


@pytest.fixture()
def pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 3)) + [0, 5e4, 0]
    x[2:, 1] += 0.7 * x[:-2, 0]
    signals = {("long", c): x[:, k] for k, c in enumerate("abc")} | {("long", "flat"): np.ones(700)} | {("short", c): x[:20, k] for k, c in enumerate("ab")} | {("two", c): x[:2, k] for k, c in enumerate("ab")}
    df = spark.createDataFrame([(r, c, i, float(v)) for (r, c), s in signals.items() for i, v in enumerate(s)], "recording string, channel string, idx long, value double")
    df.createOrReplaceTempView("some_samples")
    sql.register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield df, sql.PAIRS.format(samples="some_samples")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_coherence(spark, pairs):
    df, table = pairs
    got = {(r["recording"], r["channel_x"], r["channel_y"], r["bin"]): r for r in spark.sql(f"SELECT * FROM coherence(10.0D, 64, TABLE({table}) PARTITION BY (recording, channel_x, channel_y) ORDER BY idx)").collect()}
    want = {(r["recording"], r["channel_x"], r["channel_y"], r["bin"]): r for r in spectral.coherence(df, 10.0, 64).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["frequency"] == pytest.approx(r["frequency"]) and got[k]["confidence"] == pytest.approx(r["confidence"])
        if "flat" not in k:
            assert got[k]["coherence"] == pytest.approx(r["coherence"], abs=1e-7)


def test_granger(spark, pairs):
    df, table = pairs
    for order in (1, 4):
        got = {tuple(r[:3]): r for r in spark.sql(f"SELECT * FROM granger({order}, TABLE({table}) PARTITION BY (recording, channel_x, channel_y) ORDER BY idx)").collect()}
        want = {tuple(r[:3]): r for r in directed.granger_causality(df, 10.0, order).collect() if "flat" not in r}
        for k, r in want.items():
            assert (got[k]["status"] == "ok") == (r["status"] == "ok")
            assert r["status"] != "ok" or (got[k]["gc_xy"] == pytest.approx(r["gc_xy"], abs=1e-6) and got[k]["gc_yx"] == pytest.approx(r["gc_yx"], abs=1e-6))
        assert got["two", "a", "b"]["gc_xy"] is None and got["long", "a", "b"]["gc_xy"] >= 0


def test_refused(spark, pairs):
    with pytest.raises(Exception, match="two samples"):
        spark.sql(f"SELECT * FROM coherence(10.0D, 1, TABLE({pairs[1]}) PARTITION BY (recording, channel_x, channel_y) ORDER BY idx)").collect()
