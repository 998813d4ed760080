"""The manifest against a plain-Python tree of the same rows."""

import hashlib
import zlib

import pytest

from conftest import SF_SMALL
from surgekit.llm import merkle_manifest as mm
from surgekit.llm.shared import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(levels, i):
    """(siblings by level, fold of a digest) of place ``i`` in a tree."""
    steps = []
    for level in levels[:-1]:
        first = i // 16 * 16
        steps.append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
        i //= 16
    return steps


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k:k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, leaf_of(r, r[1])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(tree([h for _, h in groups[s]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, (r, h) in enumerate(groups[s]):
            steps = climb(trees[k], i) + climb(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf_of(r, lower(r[1])) if bad else h
            for before, after in steps:
                fold = sha(before, fold, after)
            out.append((r[0], h, trees[k][-1][0], top[-1][0], sha(*(x for step in steps for x in step)), fold, fold == top[-1][0]))
    return out


def corpus(sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += 1
            text = [None, "", "abc", "Große Wörter " * (i % 7), "Text Nummer %d ÄÖ" % i][i % 5]
            rows.append((i * 7919 % 100_003, text, "de" if i % 3 else None, s, len(text) if text else None, "clash", "clash"))
    return rows


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2}, {"hot": 300, "b": 17, "c": 1, None: 16, "é": 33, "z": 2},
                                   {f"s{k}": 1 + k % 3 for k in range(40)}, {None: 5}])
def test_matches_brute_force(spark, sizes):
    rows = corpus(sizes)
    extra = [(None, "No id At all", None, "b", None, None, None)] * 2 if "b" in sizes else []
    rows += extra + (rows[:2] if len(rows) > 3 else [])  # null ids, repeated rows
    got = [tuple(r) for r in mm.verify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_whole_table_and_tampering(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in mm.verify(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_empty_table_and_settings(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    out = mm.verify(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and [f"{n} {t}" for n, t in out.dtypes][0] == "doc_id bigint"
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
