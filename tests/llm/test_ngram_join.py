"""The Jaccard join against all pairs, and components against a union-find."""

import importlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from surgekit.llm import ngram_join
from surgekit.llm.components import between, components
from surgekit.llm.shared import staged

SCHEMA = "doc_id long, text string, n long, token string, h int"


def brute(rows, size, num, den):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, len(sets[i]), c if (c := least.get(root(i))) is not None else -1)
                  for i, r in enumerate(rows))


def corpus(seed, size, num, den):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "é", "ÀB", "x.y"]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t\n", "one", "one two", "One  TWO", "two one", "a b c", "A B C", "a b c d e f"]
    for _ in range(12):
        base = prose(r.choice([8, 30, 60, 120]))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(w))
                w[at:at + r.randint(0, 1)] = [r.choice(vocabulary)]
            texts.append(r.choice([" ", "  ", "\n"]).join(w))
    chain = prose(100)
    for _ in range(30):  # each links with the next ones only
        chain = [*chain[2:], *prose(2)]
        texts.append(" ".join(chain))
    passage = prose(40)
    texts += [" ".join(prose(r.randint(5, 50)) + passage) for _ in range(25)]
    rows = [(i * 7 % 1000, t, 5, "clash", None) for i, t in enumerate(texts)]
    return [*rows, (rows[20][0], texts[20], 0, None, 1), (None, texts[25], 0, None, 1), (None, "all alone here now", 0, None, 1)]


@pytest.mark.parametrize("seed,size,num,den", [(1, 3, 90, 100), (2, 5, 4, 5), (3, 2, 1, 2)])
def test_matches_all_pairs(spark, seed, size, num, den):
    rows = corpus(seed, size, num, den)
    out = ngram_join.document_components(spark.createDataFrame(rows, SCHEMA).repartition(4), size, num, den)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"],
                  r["component_id"] if r["component_id"] is not None else -1) for r in out.collect())
    want = brute(rows, size, num, den)
    assert got == want
    if seed == 2:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        kept = ngram_join.one_of_each(df, size, num, den)
        assert kept.columns == df.columns
        empty = sum(n == 0 for _, n, _ in want)
        assert kept.count() == empty + len({c for _, n, c in want if n and c >= 0}) + sum(n > 0 and c < 0 for _, n, c in want)
        assert {r["doc_id"] for r in kept.collect()} >= {c for _, n, c in want if c >= 0}


def test_empty(spark):
    assert ngram_join.document_components(spark.createDataFrame([], SCHEMA), 3, 90, 100).collect() == []
    only = spark.createDataFrame([(1, None, 0, "", 0), (2, " ", 0, "", 0)], SCHEMA)
    assert sorted(tuple(r) for r in ngram_join.document_components(only, 3, 90, 100).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    r = random.Random(4)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = [*path, *star, (5, 5), (7, 3), (3, 7), *[(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {c["node"]: c["component"] for c in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars already are written once; each round that is run changes them."""
    module = importlib.import_module("surgekit.llm.components")
    written = []
    monkeypatch.setattr(module, "staged", lambda df, name: written.append(staged(df, name)) or written[-1])
    star = [(1000 + i, 1000) for i in range(1, 50)] + [(7, 3), (3, 7), (9, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert got == {1000 + i: 1000 for i in range(50)} | {7: 3, 3: 3} and len(written) == 1
    written.clear()
    assert components(spark.createDataFrame([], "u long, v long")).collect() == [] and len(written) == 1
    written.clear()
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 4)], "u long, v long")).collect()}
    assert got == dict.fromkeys(range(1, 6), 1)
    rounds = [sorted(map(tuple, w.collect())) for w in written]
    assert all(a != b for a, b in zip(rounds, rounds[1:], strict=False))


def test_later_edges_join_components(spark):
    """Labels of all edges, and those of some with the others between their components, are the same."""
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300, 301), (301, 302)]
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    labels = components(frame(edges[:80]))
    over = {x["node"]: x["component"] for x in components(between(frame(edges[80:]), labels)).collect()}
    first = {x["node"]: x["component"] for x in labels.collect()}
    want = {x["node"]: x["component"] for x in components(frame(edges)).collect()}
    assert {n: over.get(first.get(n, n), first.get(n, n)) for n in want} == want


def test_null_ids_with_equal_short_hashes_are_kept_apart(spark):
    """Two texts that a 32-bit hash can't tell apart, both without an id: neither is lost, and neither takes the other's links."""
    some = spark.range(400_000).select(F.concat(F.lit("left or right text of number "), "id").alias("text"))
    twins = some.groupBy(F.hash(F.col("text").cast("binary")).alias("k")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b")
    a, b = twins.orderBy("k").select("a", "b").first()
    near = a + " and more of the same words so that one word differs"
    rows = [(None, a, 0, None, 0), (None, b, 0, None, 0), (7, b, 0, None, 0), (8, near, 0, None, 0), (None, near, 0, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_join.document_components(df, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)
    assert sorted(r["text"] for r in ngram_join.one_of_each(df, 3, 90, 100).collect()) == sorted([a, b, near])
