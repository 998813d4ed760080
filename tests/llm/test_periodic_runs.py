"""Runs against all periods of all stretches, and the digest against plain loops."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from conftest import SF_SMALL
from surgekit.llm import periodic_runs as pr
from surgekit.llm.shared import table

SCHEMA = "doc_id long, text string, body string, runs string"


def brute(w):
    """By every lag: longest stretches of words that equal the ones a lag before, of equal stretches the least lag."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(12, 2 * q):
                best.setdefault((s, length), q)
            i = j
    return sorted((s, n_, q) for (s, n_), q in best.items())


def codes(w):
    return np.array([hash(("x", x)) & (2**64 - 1) for x in w], np.uint64)


def sequences(r):
    k = r.randint(1, 3)
    w = [r.randint(0, k) for _ in range(r.randint(0, 60))]
    for _ in range(r.randint(0, 4)):  # repeat blocks, nested
        a = r.randint(0, len(w))
        block = w[a:a + r.randint(1, 14)]
        times = r.randint(1, 6)
        w[a:a] = block * times + block[:r.randint(0, len(block))]
    return w


def test_random_sequences():
    r = random.Random(3)
    for _ in range(4000):
        w = sequences(r)
        assert pr.find_runs(codes(w)) == brute(w), w


@pytest.mark.parametrize("w", [[0] * 500, [0, 1] * 100, ([0, 1] * 6 + [0]) * 4, ([0] * 13 + [1]) * 9 + [0] * 40,
                               [x for k in range(30) for x in [0] * 20 + [k]], (([0] * 12 + [1]) * 3 + [2]) * 3, list(range(50)) * 3,
                               ([0, 0, 1] * 5 + [0, 1]) * 5, [0] * 11, [0] * 12, list(range(6)) * 2, list(range(7)) * 2])
def test_special_sequences(w):
    assert pr.find_runs(codes(w)) == brute(w)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert pr.find_runs(codes(b)) == brute(b)


def test_long_texts_stay_cheap():
    t0 = time.time()
    assert pr.find_runs(codes([7] * 300_000)) == [(0, 300_000, 1)]
    lines = [x for k in range(2000) for x in [0] * 60 + [k + 1]]
    assert len(pr.find_runs(codes(lines))) == 2000
    block = np.random.default_rng(1).integers(0, 50, 30_000).tolist()
    assert (0, 90_000, 30_000) in pr.find_runs(codes(block * 3))
    assert time.time() - t0 < 60


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_digest(spark):
    r = random.Random(8)
    rows = [(i, r.choice([" ", "\n", "\t ", "  "]).join(r.choice("abcé") for _ in range(r.randint(0, 90))), "c", None) for i in range(150)]
    rows += [(None, "a " * 40, None, None), (500, None, None, None), (501, "", None, None), (502, " \n\x0b\x0c\r", None, None),
             (20, "x y " * 3000, None, None), *rows[:3], *rows[:3]]
    got = [tuple(x) for x in pr.run_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    want = [expected(d, t) for d, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[1] > 0 for x in want) > 10


def test_collapse_returns_texts_and_spans(spark):
    rows = [(1, "go " + "on and " * 8 + "stop", None, None), (2, None, None, None), (10, "a b c d", None, None)]
    got = {x["doc_id"]: x for x in pr.collapse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["collapsed"] == "go on and stop" and [tuple(x) for x in got[1]["runs"]] == [(1, 16, 2)]
    assert got[2]["collapsed"] == "" and got[10]["collapsed"] == "a b c d"


def test_empty_table_and_given_table(spark):
    assert pr.run_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = table(spark, SF_SMALL, "documents")
    short = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 6000]
    got = {x["doc_id"]: tuple(x) for x in pr.run_digest(docs).collect()}
    for d, t in short:
        assert got[d] == expected(d, t), d
