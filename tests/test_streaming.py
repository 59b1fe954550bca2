import datetime as dt

import numpy as np

from tracksmith.operators import smoothing
from tracksmith.streaming import forward


def drained(spark, df, tmp_path, name):
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-log").option("path", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}").collect()


def test_states_of_a_growing_log(spark, tmp_path):
    rng = np.random.default_rng(2)
    schema = "trip_id string, idx long, x double, y double, speed double, acc_h double, acc_v double"
    rows = {name: [(name, k, None if k in gaps else 3.0 * k + rng.normal(), 2.0 * k, 3.6 if k % 5 else -1.0, 2.0, 2.0) for k in range(30)] for name, gaps in (("a", (10, 11)), ("b", (0, 1, 20)), ("c", ()))}
    rows["c"][17] = ("c", 17, 1e7, 0.0, 3.6, 2.0, 2.0)
    for k, part in enumerate((range(0, 12), range(12, 13), range(13, 30))):
        late = [rows["a"][3]] if k == 2 else []  # behind the trip's last: left out
        spark.createDataFrame([r for v in rows.values() for j, r in enumerate(v) if j in part] + late, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    # Files come in the order of their age, so a batch may be any two of a part; the sum is the same as in one batch.
    got = {}
    for r in drained(spark, forward.forward_states(stream), tmp_path, "out"):
        got.setdefault(r.trip_id, []).append(r)
    for name, v in rows.items():
        a = np.array([[np.nan if c is None else c for c in r[2:]] for r in v], float)
        first = 2 if name == "b" else 0
        state, want, broken = smoothing.initial(a[first]), [], False
        for row in a[first:]:
            state, error = smoothing.advance(state, row)
            broken = broken or error > smoothing.MAX_ERROR
            want.append((state, broken))
        out = sorted(got[name], key=lambda r: r.idx)
        assert [r.idx for r in out] == list(range(first, 30)) and [r.rejected for r in out] == [b for _, b in want]
        assert all(np.allclose(r.x, s.x) and np.allclose(np.reshape(r.p, (4, 4)), s.p) for r, (s, _) in zip(out, want, strict=True))
        if name != "c":
            assert all(np.allclose(r.x, s.x) for r, s in zip(out, smoothing.forward(a), strict=True))
    assert any(r.rejected for r in got["c"]) and not any(r.rejected for r in got["a"])


def test_sessions_of_a_growing_log(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    batches = [[("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(9)), ("b", at(3)), ("a", at(9, 30))], [("z", at(60))], [("a", at(1, 5)), ("z", at(61))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "who string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("who string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((r.who, r.started, r.ended, r.n) for r in drained(spark, forward.sessions(stream, "who", "at"), tmp_path, "out"))
    assert got == [("a", at(0), at(1), 2), ("a", at(9), at(9, 30), 2), ("b", at(2), at(3), 2)]  # z is open still, and the point at 1:05 came too late
