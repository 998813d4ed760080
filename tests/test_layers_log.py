"""Month-partitioned layers (scan by date, merge in place) and the compacted poll log."""

import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from surgekit.operators import control as C
from surgekit.sources import io as IO
from surgekit.sources import layers as LY
from surgekit.streaming import streams as S

SCHEMA = "k long, d date, v string, w int"


def make(spark, root, rows):
    IO.materialize_layer(spark.createDataFrame(rows, SCHEMA), root, "mart", "t", "d", cluster_by=["k"])
    return f"{IO.layer_path(root, 'mart')}/t"


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows_of(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).select("k", "d", "v", "w").collect()), key=repr)


def day(y, m, d):
    return datetime(y, m, d).date()


BASE = [(k, day(2001, 1 + k % 6, 1 + k % 27), f"v{k}", k) for k in range(60)] + [(100, None, "none", 1), (101, day(2002, 1, 1), "alone", 2)]


def test_scan_lists_only_the_months_of_the_range(spark, tmp_path):
    path = make(spark, str(tmp_path), BASE)
    got = LY.scan_dates(spark, path, "d", day(2001, 2, 10), day(2001, 4, 1))
    assert sorted(r["k"] for r in got.collect()) == sorted(k for k, d, *_ in BASE if d and day(2001, 2, 10) <= d < day(2001, 4, 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("_part=")[1][:7] for f in spark.read.parquet(path).where(F.col("_part").between(day(2001, 2, 1), day(2001, 4, 1))).inputFiles()}
    assert len(read) >= 2 and "Python" not in plan
    assert LY.scan_dates(spark, path, "d", day(1990, 1, 1), day(1990, 2, 1)).collect() == []


def test_merge_rewrites_touched_months_alone(spark, tmp_path):
    path = make(spark, str(tmp_path), BASE)
    before = files(path)
    src = [(1, day(2001, 2, 5), "same month", 7), (2, day(2001, 5, 9), "moved", 8), (101, day(2001, 5, 1), "leaves its month empty", 9),
           (500, day(2003, 3, 3), "new month", 1)]
    touched = LY.merge_layer(spark, path, spark.createDataFrame(src, SCHEMA), ["k"], "d")
    assert {m.isoformat()[:7] for m in touched} == {"2001-02", "2001-03", "2001-05", "2002-01", "2003-03"}
    want = sorted([r for r in BASE if r[0] not in {s[0] for s in src}] + src, key=repr)
    assert rows_of(spark, path) == want
    months = ("2001-02", "2001-03", "2001-05", "2002-01", "2003-03")
    rewritten = {f for f in before if any(f"_part={m}" in f for m in months)}
    assert before - files(path) == rewritten and not os.path.exists(f"{path}/_part=2002-01-01")
    # again: nothing changes
    LY.merge_layer(spark, path, spark.createDataFrame(src, SCHEMA), ["k"], "d")
    assert rows_of(spark, path) == want


def test_merge_cases(spark, tmp_path):
    path = make(spark, str(tmp_path), BASE)
    before = files(path)
    assert LY.merge_layer(spark, path, spark.createDataFrame([], SCHEMA), ["k"], "d") == set() and files(path) == before
    with pytest.raises(Exception, match="several rows"):
        LY.merge_layer(spark, path, spark.createDataFrame([(1, None, "a", 1), (1, None, "b", 2)], SCHEMA), ["k"], "d")
    assert files(path) == before
    part = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (100, "z", 3), (900, "n", 4)], "k long, v string, at int")
    LY.merge_layer(spark, path, part, ["k"], "d", update_cols=["v"], order_cols=["at"])
    want = {r[0]: r for r in BASE}
    want[3] = (3, want[3][1], "y", 3)
    want[100] = (100, None, "z", 1)
    want[900] = (900, None, "n", None)
    assert rows_of(spark, path) == sorted(want.values(), key=repr)


def test_stopped_merge_is_mended_by_the_next(spark, tmp_path, monkeypatch):
    path = make(spark, str(tmp_path), BASE)
    src = spark.createDataFrame([(101, day(2001, 5, 1), "moved", 9)], SCHEMA)

    def stop(*a):
        raise RuntimeError("crash")
    with monkeypatch.context() as m:
        m.setattr(LY, "remove", stop)
        with pytest.raises(RuntimeError):
            LY.merge_layer(spark, path, src, ["k"], "d")
    LY.merge_layer(spark, path, src, ["k"], "d")
    assert rows_of(spark, path) == sorted([r for r in BASE if r[0] != 101] + [(101, day(2001, 5, 1), "moved", 9)], key=repr)


def brute_signals(polls):
    series, out = defaultdict(list), {}
    for k, t in polls:
        series[k].append(t)
    for k, ts in series.items():
        t0 = min(ts)
        out[k] = (t0, len(ts), *(sum((t - t0) <= timedelta(hours=h) for t in ts) for h in S.SIGNAL_HOURS))
    return out


def signals(df):
    return {r["key"]: (r["t0"], r["v7_views_at_poll"], r["e1_views_6h"], r["e2_views_24h"], r["e3_views_48h"]) for r in df.collect()}


def test_log_with_late_replayed_and_compacted_batches(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [[(r.randrange(12), start + timedelta(hours=r.randrange(400))) for _ in range(150)] for _ in range(6)]
    batches = [spark.createDataFrame(b, "k long, t timestamp") for b in rows]
    log = str(tmp_path / "log")
    write = S.early_signal_batch_writer(log, "k", "t")
    assert S.compact_early_signals(spark, log) == -1 and S.read_early_signals(spark, log).collect() == []
    write(batches[0], 0)
    write(batches[1], 1)
    assert S.compact_early_signals(spark, log) == 1
    pinned = S.read_early_signals(spark, log)   # planned before what follows
    write(batches[1], 1)                        # a replay of what the base holds
    write(batches[2], 2)
    write(batches[2], 2)
    assert signals(S.read_early_signals(spark, log)) == brute_signals(sum(rows[:3], []))
    with monkeypatch.context() as m:            # a compaction that stops before its pointer
        m.setattr(S, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            S.compact_early_signals(spark, log)
    assert signals(S.read_early_signals(spark, log)) == brute_signals(sum(rows[:3], []))
    write(batches[3], 3)
    assert S.compact_early_signals(spark, log) == 3 and S.compact_early_signals(spark, log) == 3
    S.expire_polls(spark, log, keep=2)
    assert signals(pinned) == brute_signals(sum(rows[:2], []))
    assert signals(S.read_early_signals(spark, log, version=1)) != {}
    write(batches[4], 4)
    write(batches[5], 5)
    assert signals(S.read_early_signals(spark, log)) == brute_signals(sum(rows, []))
    S.compact_early_signals(spark, log)
    S.expire_polls(spark, log)
    names = sorted(n.split("-")[0] for n in os.listdir(log) if not n.startswith("."))
    assert names == ["base", "current"]         # one base, one pointer: batches, older and unpublished bases are gone
    assert signals(S.read_early_signals(spark, log)) == brute_signals(sum(rows, []))
    # bounded: a key's polls of the first 48 hours and one row more
    kept = Counter(p["key"] for p in S.read_polls(spark, log).collect())
    early = {k: len({t for q, t in sum(rows, []) if q == k and t - v[0] <= timedelta(hours=48)}) for k, v in brute_signals(sum(rows, [])).items()}
    assert all(n <= early[k] + 1 for k, n in kept.items())


def test_run_log_append(spark):
    log = spark.createDataFrame([(7, 1, datetime(2024, 1, 1), 5, "success", None, 1.0)],
                                "log_id long, channel_id long, crawl_ts timestamp, records_fetched int, status string, error_msg string, "
                                "execution_time_seconds double")
    runs = spark.createDataFrame([(2, "failed", 9, "boom"), (1, "success", 4, "ignored"), (1, "success", 4, "ignored"), (3, "running", 1, None),
                                  (None, "success", None, None), (4, None, 1, None)],
                                 "channel_id long, status string, records_fetched int, error_msg string")
    got = C.append_run_log(log, runs, "2024-02-01")
    rows = sorted((tuple(r)[0], r["channel_id"], r["status"], r["records_fetched"], r["error_msg"]) for r in got.collect())
    assert rows == [(7, 1, "success", 5, None), (8, None, "success", None, None), (9, 1, "success", 4, None), (10, 1, "success", 4, None),
                    (11, 2, "failed", None, "boom")]
    assert {str(r["crawl_ts"])[:10] for r in got.where("log_id > 7").collect()} == {"2024-02-01"}
    first = C.append_run_log(log.where("false"), runs, "2024-02-01")
    assert sorted(r["log_id"] for r in first.collect()) == [1, 2, 3, 4]
    assert C.append_run_log(log, runs.where("false")).count() == 1
