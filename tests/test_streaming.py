import os
from datetime import datetime, timedelta

from pulseforge.operators import rhythm as R
from pulseforge.streaming import live


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_live_intervals_are_the_batch_ones(spark, tmp_path):
    """Files of beats that arrive out of order, some of them late by less than the watermark, one far too late."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = datetime(2024, 1, 1, 8)
    t = [0, 800, 1600, 2400, 3800, 4600, 5400, 7700, 8500, 9300, 10_100, 10_500, 11_300, 12_100]
    rows = {(r, k): (r, t0 + timedelta(milliseconds=x + r), x + r, "V" if k == 4 else "N") for r in (0, 1) for k, x in enumerate(t)}
    schema = "record_id long, ts timestamp, t_ms long, label string"
    # Beats 5 and 2 come in later files than their successors; the last rows move the watermark past all.
    files = [[0, 1, 3], [6, 2, 4], [8, 5, 7, 9], [12, 10, 11, 13]]
    end = [[(r, t0 + timedelta(hours=h), 3_600_000 * h, "N") for r in (0, 1)] for h in (1, 2)]
    late = [(0, t0 + timedelta(milliseconds=2000), 2000, "N")]
    parts = [[rows[r, k] for k in ks for r in (0, 1)] for ks in files] + [end[0], late, end[1], [(5, t0 + timedelta(hours=h), 0, "N") for h in (9,)], [(5, t0 + timedelta(hours=20), 1, "N")]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        (path,) = (p for p in (tmp_path / "in" / str(n)).iterdir() if p.name.startswith("part"))
        path.rename(tmp_path / "in" / f"{n:02d}.parquet")
        os.utime(tmp_path / "in" / f"{n:02d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    got = run(spark, live.live_intervals(stream, "10 seconds"), "intervals", "append").collect()
    batch = spark.createDataFrame([(r, k, row[2], row[3]) for (r, k), row in rows.items()], "record_id long, k long, t_ms long, label string")
    want = R.malik_filter(R.nn_intervals(rr=R.rr(beat=batch))).collect()
    assert sorted((r["record_id"], r["t_ms"], r["nn"], r["kept"]) for r in got) == sorted((r["record_id"], r["t_ms"], r["nn"], r["kept"]) for r in want)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_live_labels(spark, tmp_path):
    log = spark.createDataFrame([(0, 5, 1, "V"), (0, 5, 3, "N"), (0, 5, 2, "S"), (0, 9, 4, "X")], "record_id long, t_ms long, seq long, label string")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    got = run(spark, live.live_labels(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))), "labels_now", "complete").collect()
    assert sorted((r["t_ms"], r["label"]) for r in got) == [(5, "N"), (9, "X")]


def test_live_minutes_and_runs(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 8)
    rows = [(0, t0 + timedelta(seconds=s), label) for s, label in ((1, "N"), (2, "V"), (3, "V"), (50, "V"), (70, "S"), (4000, "N"))]
    beats = spark.createDataFrame(rows, "record_id long, ts timestamp, label string")
    beats.coalesce(1).write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "b"))
    got = run(spark, live.live_minutes(stream), "minutes_now", "complete").collect()
    assert sorted((r["beats"], r["v"], r["s"]) for r in got) == [(1, 0, 0), (1, 0, 1), (4, 3, 0)]
    got = run(spark, live.live_runs(stream), "runs_now", "complete").collect()
    assert sorted(r["n"] for r in got) == [1, 2]
