"""Suffix dedup against a brute-force dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from surgekit.llm import hashing, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    docs = [None, "", "x" * 199, "x" * 200, "y" * 500, "ab" * 300, prose(30)]
    for i in range(60):
        parts = [prose(r.randint(0, 60)) for _ in range(2)]
        parts.insert(1, r.choice(shared)[r.randint(0, 40):])
        docs.append(" ".join(parts))
    base = prose(300)
    for _ in range(25):  # near copies
        w = base.split(" ")
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [docs[10], docs[10], base[:205], base[3:204], base[-200:], base[100:300] + base[100:300]]
    return docs


def test_matches_brute_force(spark):
    docs = corpus()
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(docs)
    for i, (n, removed, runs, sha, _) in enumerate(brute(docs)):
        g = got[i]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (n, removed, runs, sha), i


def test_remove_repeats_keeps_rows_and_columns(spark):
    docs = corpus(9)[:40]
    rows = [(i if i % 7 else None, t, None, "s", 3, "clash") for i, t in enumerate(docs)] + [(1, docs[20], None, None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA + ", body string")
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want = Counter(k.decode("utf-8", "ignore") for *_, k in brute([r[1] for r in rows]))
    assert Counter(r["text"] for r in out.collect()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup_digest(df).collect() == []
    assert suffix_dedup.remove_repeats(df).collect() == []


def test_anchor_choice_does_not_depend_on_the_surroundings():
    r = np.random.default_rng(1)
    data = r.integers(97, 101, 3000).astype(np.uint8)
    owners = suffix_dedup._owners(hashing.windows(data, suffix_dedup.GRAM), 2801)
    part = suffix_dedup._owners(hashing.windows(data[500:1500], suffix_dedup.GRAM), 801)
    assert (part + 500 == owners[500:1301]).all()
