"""Generic operators against brute-force Python on hand-made data, including a hot key holding a third
of all rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from surgekit.operators import ordering as O
from surgekit.operators import quantiles as Qn
from surgekit.operators import tables as T


def _skewed_rows(n=3000, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rng.randint(0, 40)}"
        v = None if i % 97 == 0 else float(rng.randint(0, 500))
        rows.append((i, g, v))
    return rows


def test_exact_quantiles_match_numpy(spark):
    rows = _skewed_rows()
    df = spark.createDataFrame(rows, "id long, g string, v double")
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    got = {r["g"]: r for r in Qn.exact_quantiles(df, "v", probs, by=["g"], nparts=7).collect()}
    groups = {}
    for _, g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vals in groups.items():
        for name, p in probs.items():
            assert abs(got[g][name] - float(np.percentile(vals, p * 100))) < 1e-9
    flat = spark.createDataFrame([(i, 0.0 if i % 3 else float(i), None if i % 5 else "g") for i in range(3000)], "id long, v double, g string")
    by_g = {r["g"]: r for r in Qn.exact_quantiles(flat, "v", probs, by=["g"], nparts=7).collect()}
    for g in (None, "g"):
        vals = [0.0 if i % 3 else float(i) for i in range(3000) if (None if i % 5 else "g") == g]
        assert all(abs(by_g[g][n] - float(np.percentile(vals, p * 100))) < 1e-9 for n, p in probs.items())
    glob = Qn.exact_quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert abs(glob - float(np.median([v for _, _, v in rows if v is not None]))) < 1e-9


def test_keep_latest_and_skip_if_exists(spark):
    rows = [(1, "a", 5, 1), (2, "a", 9, 2), (3, "a", 9, 3), (4, "b", 1, 4), (5, "c", None, 5), (6, "c", 2, 6)]
    df = spark.createDataFrame(rows, "id long, k string, ts long, tie long")
    latest = {r["k"]: r["id"] for r in T.keep_latest(df, ["k"], ["ts", "tie"]).collect()}
    assert latest == {"a": 3, "b": 4, "c": 6}
    first = {r["k"]: r["id"] for r in T.keep_latest(df, ["k"], ["ts", "tie"], latest=False).collect()}
    assert first["a"] == 1
    target = spark.createDataFrame([("a",)], "k string")
    new = T.skip_if_exists(df, target, ["k"], order_cols=["ts", "tie"])
    assert sorted(r["k"] for r in new.collect()) == ["b", "c"]


def test_top_k_per_group_brute_force(spark):
    rows = _skewed_rows(2000)
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    got = T.top_k_per_group(df, ["g"], [F.desc_nulls_last("v"), F.desc("id")], 3).collect()
    want = {}
    for i, g, v in rows:
        want.setdefault(g, []).append((v if v is not None else -1e18, i))
    for g in want:
        want[g] = [i for _, i in sorted(want[g], reverse=True)[:3]]
    mine = {}
    for r in got:
        mine.setdefault(r["g"], []).append((r["rank"], r["id"]))
    assert {g: [i for _, i in sorted(v)] for g, v in mine.items()} == want


def test_symmetric_diff_and_reconcile(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, m long")
    b = spark.createDataFrame([(1, 10), (2, 21), (4, 40)], "k long, m long")
    d = {(r["k"], r["diff_source"]) for r in T.symmetric_diff(a, b).collect()}
    assert d == {(2, "a_minus_b"), (3, "a_minus_b"), (2, "b_minus_a"), (4, "b_minus_a")}
    anyr = {r["k"] for r in T.reconcile(a, b, ["k"], ["m"], mode="any").collect()}
    allr = {r["k"] for r in T.reconcile(a, b, ["k"], ["m"], mode="all").collect()}
    assert anyr == {2, 3, 4} and allr == {2}


def test_upserts(spark):
    tgt = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k long, name string, v long")
    src = spark.createDataFrame([(2, "y2", 5, 1), (2, "y3", 6, 2), (3, "z", 7, 1)], "k long, name string, v long, t long")
    out = {r["k"]: (r["name"], r["v"]) for r in T.upsert(tgt, src, ["k"], update_cols=["name", "v"],
                                                          order_cols=["t"]).collect()}
    assert out == {1: ("x", 1), 2: ("y3", 6), 3: ("z", 7)}
    add = {r["k"]: r["v"] for r in T.additive_upsert(tgt.select("k", "v"), src.select("k", "v"), ["k"], ["v"]).collect()}
    assert add == {1: 1, 2: 12, 3: 7}


def test_global_rank_running_sum_and_split(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50) if i % 11 else None, rng.randint(1, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, ts long, c long")
    order = [F.col("ts").asc_nulls_first(), F.col("id")]
    r = {x["id"]: x["global_rank"] for x in O.global_rank(df, order, nparts=6).collect()}
    want = sorted(rows, key=lambda t: (t[1] is not None, t[1] if t[1] is not None else 0, t[0]))
    assert [r[i] for i, _, _ in want] == list(range(1, 1001))
    rs = {x["id"]: x["running_sum"] for x in O.running_sum(df, order, "c", nparts=6).collect()}
    acc = 0
    for i, _, c in want:
        acc += c
        assert rs[i] == acc
    sp = O.time_split(df, "ts", "id").groupBy("split").count().collect()
    assert {x["split"]: x["count"] for x in sp} == {"train": 700, "val": 150, "test": 150}


def test_attach_scalars_is_bounded(spark):
    df = spark.createDataFrame([(1,), (2,)], "x long")
    one = df.agg(F.max("x").alias("mx"))
    assert [r["mx"] for r in T.attach_scalars(df, one).collect()] == [2, 2]
    import pytest
    with pytest.raises(Exception):
        T.attach_scalars(df, df.withColumnRenamed("x", "y")).collect()   # two rows: refused at runtime


def test_upsert_without_order_refuses_repeated_keys(spark):
    import pytest
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    once = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, T.upsert(target, once, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="several rows for one key"):
        T.upsert(target, once.union(once), ["k"]).collect()


def test_json_text_with_brackets_is_a_scalar(spark):
    from surgekit.sources.envelopes import extract_json
    rows = [('{"t": "[MV] Song", "n": 3, "o": {"a": 1}, "l": [1, 2], "z": null, "b": true}',), ('{"t": "{x}"}',), ("not json",)]
    fields = {"t": ("$.t", "value"), "n": ("$.n", "value"), "o": ("$.o", "value"), "l": ("$.l", "query"), "z": ("$.z", "value"),
              "b": ("$.b", "value")}
    got = [tuple(r) for r in extract_json(spark.createDataFrame(rows, "raw string"), "raw", fields).collect()]
    assert got == [("[MV] Song", "3", None, "[1,2]", None, "true"), ("{x}", None, None, None, None, None), (None,) * 6]


def test_large_days_get_many_write_tasks(spark, tmp_path):
    from surgekit.sources.envelopes import write_envelopes
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("{}").alias("raw"),
                                  F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ingestion_time"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_envelopes(df, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "t" / "ingest_date=2024-01-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000
