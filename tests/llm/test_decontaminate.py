"""Q-gram lemma filtering against alignment of every item with every text."""

import random

import numpy as np
import pytest

from surgekit.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edits(item: bytes, text: bytes) -> int:
    """Least edits of the item against any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (t != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def corpus(seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(n) for n in (1, 5, 8, 20, 20, 30, 40)] + ["", None, " \n", "abcabcabcabcabcabcabcabc abcabc"]

    def damaged(text, n):
        t = list(text)
        for _ in range(n):
            at = r.randrange(len(t) or 1)
            t[at:at + r.randint(0, 1)] = [r.choice("xyz q")] * r.randint(0, 1)
        return "".join(t)
    docs = [None, "", "x"]
    for i in range(80):
        item = r.choice([x for x in items if x and x.strip()])
        kind = r.random()
        inner = (item if kind < 0.3 else item.upper().replace(" ", " \n\t ") if kind < 0.5 else damaged(item, r.randint(1, 16))
                 if kind < 0.9 else item[:len(item) // 2])
        docs.append(prose(r.randint(0, 30)) + " " + inner + r.choice([" ", ". ", ""]) + prose(r.randint(0, 30)))
    return items, docs + [prose(60) for _ in range(20)] + ["abc" * 60]


@pytest.mark.parametrize("seed", [2, 3])
def test_finds_all_passages_within_budget(spark, seed, monkeypatch):
    items, docs = corpus(seed)
    bodies = [dc.normal(t) if t else b"" for t in items]
    want = set()
    index = dc.Index.of([(i, b) for i, b in enumerate(bodies) if b])
    budget = dict(zip(index.ids, index.edits.tolist(), strict=True))
    for d, t in enumerate(docs):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        text = dc.normalise(raw, np.array([0, len(raw)]))[0].tobytes()
        for i, most in budget.items():
            e = edits(bodies[i], text)
            if e <= most:
                want.add((d, i, e))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame([(d, t, "l", "s", 0) for d, t in enumerate(docs)], SCHEMA).repartition(3)
    rows = dc.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in rows} == want and len(rows) == len(want) > 30
    for r in rows:
        part = docs[r["doc_id"]].encode()[r["start"]:r["end"]].decode("utf-8", "replace")
        assert edits(bodies[r["item_id"]], dc.normal(part)) <= r["edits"] + 2
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {d for d, _, _ in want}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)  # several blocks of items
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in dc.leaks(df, bench).collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", 0), (1, "a b", "", "", 0), (None, None, None, None, None)], SCHEMA)
    bench = spark.createDataFrame([(1, "a b"), (1, "a b")], "item_id long, text string")
    none = bench.where("false")
    assert dc.leaks(docs, none).collect() == [] and dc.drop_contaminated(docs, none).count() == 3
    assert dc.leaks(docs.where("false"), bench).collect() == []
    assert dc.leaks(docs, bench).count() == 4 and dc.drop_contaminated(docs, bench).count() == 1


def banded(item, text, low, high):
    """Least edits over paths on the diagonals from low to high, cell by cell."""
    far = 10**9
    row = {j: 0 for j in range(len(text) + 1) if low <= j <= high}
    for i, c in enumerate(item, 1):
        new = {}
        for j in range(len(text) + 1):
            if low <= j - i <= high:
                new[j] = min(row.get(j - 1, far) + (j < 1 or text[j - 1] != c), row.get(j, far) + 1, new.get(j - 1, far) + 1)
        row = new
    return {j: v for j, v in row.items() if v < far}


def test_band_against_cell_by_cell_and_full_alignment():
    r = random.Random(6)
    for _ in range(400):
        item = bytes(r.choice(b"abc") for _ in range(r.randint(1, 25)))
        text = bytes(r.choice(b"abc") for _ in range(r.randint(0, 60)))
        low = r.randint(-8, 50)
        high = low + r.randint(0, 12)
        first, row = dc._last_row(item, text, low, high)
        got = {first + k: int(v) for k, v in enumerate(row) if v < dc._FAR // 2}
        assert got == banded(item, text, low, high), (item, text, low, high)
        wide = dc._last_row(item, text, -len(item) - 1, len(text) + 1)[1]
        assert int(wide.min()) == edits(item, text)


def test_counted_bands_are_the_listed_ones(monkeypatch):
    r = random.Random(9)
    items = [bytes(r.choice(b"ab ") for _ in range(n)) for n in (30, 60, 90)] + [b"-" * 70, b"xy" * 40]
    index = dc.Index.of(list(enumerate(items)))
    texts = [bytes(r.choice(b"ab ") for _ in range(400)) + items[r.randrange(5)] for _ in range(6)] + [b"-" * 500, b"xy" * 200 + b"-" * 90]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    listed = sorted(set(dc.bands(index, data, off)))
    monkeypatch.setattr(dc, "LISTED", 50)
    assert sorted(set(dc.bands(index, data, off))) == listed and len(listed) > 10


def test_long_repetitive_lines_take_no_memory(spark):
    import resource
    items = [(1, "-" * 600), (2, "ab" * 300), (3, "a clean item with words of its own and more of them")]
    docs = [(1, "-" * 2_000_000, "l", "s", 0), (2, "ab" * 500_000, "l", "s", 0), (3, "-" * 500 + "x" + "-" * 2000, "l", "s", 0)]
    index = dc.Index.of([(i, t.encode()) for i, t in items])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = {}
    for d, t, *_ in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        found[d] = {index.ids[i]: e for (_, i), (e, _, _) in dc.search(index, raw, np.array([0, len(raw)])).items()}
    assert found == {1: {1: 0}, 2: {2: 0}, 3: {1: 0}}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # KB


def test_edited_passages_within_the_budget_are_found():
    """Recall over passages of 60 to 400 bytes with as many edits as the budget allows: all."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    for _ in range(150):
        item = dc.normal(" ".join(word() for _ in range(r.randint(12, 60))))
        index = dc.Index.of([(1, item)])
        passage = bytearray(item)
        for _ in range(int(index.edits[0])):
            at = r.randrange(len(passage))
            passage[at:at + r.choice((0, 1, 1))] = bytes([r.choice(b"xyz")]) * r.choice((0, 1))
        text = (" ".join(word() for _ in range(40)) + " ").encode() + bytes(passage) + b" tail words"
        assert dc.search(index, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
