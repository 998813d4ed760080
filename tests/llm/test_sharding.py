"""The shards' law, slots, and how many links stay whole."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from conftest import SF_SMALL
from surgekit.llm import sharding
from surgekit.llm.shared import table

SCHEMA = "doc_id long, text string, shard string, size string"


def check(rows, got, shards=16):
    """Every row once, sizes near equal, slots gapless."""
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    slots, loads = defaultdict(list), Counter({s: 0 for s in range(shards)})
    for r in got:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max((r["size"] for r in got), default=0)
    assert max(loads.values()) - min(loads.values()) <= max(largest, sum(loads.values()) // 1000)
    return loads


def corpus(n, seed=2):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abcdé ") for _ in range(r.randint(5, 60))), None, None) for i in range(n)]
    rows += [(n + i, "the hot text", "x", None) for i in range(n // 2)]  # a third of all rows
    for g in range(n // 10):
        rows += [(2 * n + 10 * g + k, f"group {g} " * 4, None, None) for k in range(r.randint(2, 6))]
    return rows


def test_law_and_links(spark):
    rows = corpus(600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(rows, sharding.assign(df).collect())
    placed = sharding.place(df)
    shard_of = defaultdict(Counter)
    for r in placed.collect():
        shard_of[bytes(r["name"])][r["shard"]] += 1
    groups = [c for c in shard_of.values() if sum(c.values()) > 1]
    hot = max(groups, key=lambda c: sum(c.values()))
    whole = sum(len(c) == 1 for c in groups) / len(groups)
    assert whole > 0.95 and len(hot) <= 8
    links, cut = sharding.cut_links(placed).first()
    assert links == sum(sum(c.values()) - 1 for c in groups) and cut == sum(sum(c.values()) - max(c.values()) for c in groups)


def test_hostile_rows(spark):
    rows = [(None, None, None, None), (1, None, None, None), (1, "", None, None), (2, "z" * 200_000, None, None), (3, "é", None, None),
            *[(4, "same", None, None)] * 30]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    check(rows, got)


def test_only_copies_and_other_shard_counts(spark):
    rows = [(i, f"text {i % 40}", None, None) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    loads = check(rows, sharding.assign(df, 7).collect(), 7)
    assert max(loads.values()) < 1.02 * min(loads.values())


def test_empty_table(spark):
    out = sharding.assign(spark.createDataFrame([], SCHEMA))
    assert out.collect() == []
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint",
                                "grown_shard": "int"}


def test_given_table_and_plan(spark):
    docs = table(spark, SF_SMALL, "documents")
    out = sharding.assign(docs)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("room,want", [([5, 0], [1, 0]), ([6, 100], [1024, 1024]), ([0, 3], [0, 7])])
def test_admission(room, want):
    asked = {(0, 0): 5, (0, 1): 1, (1, 0): 3, (1, 7): 9}
    assert sharding._admitted(asked, room, 2) == want
