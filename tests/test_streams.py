"""A stateful stream of shuffled, late and repeated files, stopped and started again, against the finished table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonarium.streaming import lagged

SCHEMA = "ts timestamp, channel string, value double"


def test_stream_equals_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 3000
    at, who = rng.integers(0, 20 * 86400, n), rng.choice(["x", "y", "other"], n)
    df = spark.createDataFrame([(int(a), str(c), float(v)) for a, c, v in zip(at, who, rng.standard_normal(n))] + [(5, "x", None), (None, "y", 1.0)], "s long, channel string, value double")
    df = df.select(F.timestamp_seconds("s").alias("ts"), "channel", "value")
    df.repartition(6, F.rand(3)).write.parquet(f"{tmp_path}/in")  # each file holds all times
    want = {(r["win"], r["lag"]): r for r in lagged.lagged_correlation(df, "x", "y", 3600, 24, 12, 2).collect()}

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = lagged.lagged_correlation(stream, "x", "y", 3600, 24, 12, 2, "30 days")
        going = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        going.awaitTermination(120)
        assert going.exception() is None

    run()
    more = spark.createDataFrame([(100 * 86400, "x", 1.0)], "s long, channel string, value double").select(F.timestamp_seconds("s").alias("ts"), "channel", "value")
    more.write.mode("append").parquet(f"{tmp_path}/in")
    run()  # goes on from the state of the first run; the far event closes all windows but its own
    got = spark.read.schema(lagged.OUT).parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(want) == len({(r["win"], r["lag"]) for r in got})
    for r in got:
        w = want[r["win"], r["lag"]]
        assert r["n"] == w["n"] and r["correlation"] == (None if w["correlation"] is None else pytest.approx(w["correlation"], abs=1e-9))


def test_lags_of_a_window(spark):
    x = np.random.default_rng(2).standard_normal(24)
    rows = [(3600 * k, "x", float(v)) for k, v in enumerate(x)] + [(3600 * (k + 2), "y", float(v)) for k, v in enumerate(x[:-2])]
    df = spark.createDataFrame(rows, "s long, channel string, value double").select(F.timestamp_seconds("s").alias("ts"), "channel", "value")
    got = {r["lag"]: r for r in lagged.lagged_correlation(df, "x", "y", 3600, 24, 24, 3).where("win = 0").collect()}
    assert got[2]["correlation"] == pytest.approx(1) and got[2]["n"] == 22 and abs(got[-1]["correlation"]) < 0.9
    assert got[1]["correlation"] == pytest.approx(np.corrcoef(x[:23], np.concatenate([[0, 0], x[:-2]])[1:])[0, 1])
    apart = {r["win"] for r in lagged.lagged_correlation(df, "x", "y", 3600, 4, 10, 1).collect()}
    assert apart == {0, 1, 2}  # steps 4 to 9 and 14 to 19 are in no window
    for bad in ((1, 1, 0), (24, 0, 1), (24, 1, 23)):
        with pytest.raises(ValueError):
            lagged.lagged_correlation(df, "x", "y", 3600, *bad)
