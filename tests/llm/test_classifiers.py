"""Quality and toxicity classifiers and the url filter: held-out accuracy, hostile rows, rules against a plain loop."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surgekit.llm import quality_pu, text_features, toxicity, url_filter
from surgekit.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, score double, x string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=600):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    insults = ["glorbag", "snivelwit", "dreckhead"]
    docs, labels = [], []
    for i in range(n):
        words = [word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(20, 200))]
        good, toxic = r.random() < 0.8, r.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(insults))
        if not good:
            words = r.choice([lambda: [w + "$$$" for w in words], lambda: [w.upper() + "!!" for w in words],
                              lambda: [words[0]] * 80, lambda: [w + " |" for w in words]])()
        docs.append((i, " ".join(words), "en", "s", 9.0, "clash"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    hostile = [(None, "no id at all", None, None, None, None), (9001, None, None, None, None, None), (9002, "", None, None, None, None),
               (9003, "x" * 300_000, None, None, None, None), (9004, " \n\t ", None, None, None, None), docs[3], docs[3]]
    odd = [(None, 1, 1), (9001, None, None), (123456789, 1, 0), labels[5], (labels[7][0], 1 - labels[7][1], 0)]
    return spark.createDataFrame(docs + hostile, DOCS).repartition(3), spark.createDataFrame(labels + odd, LABELS), dict(
        (i, (q, t)) for i, q, t in labels), len(docs) + len(hostile)


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(tables, name):
    docs, labels, known, n = tables
    run, parts, out = ((quality_pu.quality_scores, 3, 1) if name == "quality" else (toxicity.toxicity_scores, 5, 0))
    rows = run(docs, labels).collect()
    assert len(rows) == n and rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    hits = []
    for r in rows:
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == out)
        if r["held_out"] and r["doc_id"] in known:
            hits.append(r["predicted"] == known[r["doc_id"]][name == "toxic"])
    assert len(hits) > 60 and np.mean(hits) > 0.95


def test_labels_of_the_held_out_fold_are_not_read(spark, tables):
    docs, labels, _, _ = tables
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality",
                                "toxic")
    a, b = (quality_pu.train(docs, x) for x in (labels, flipped))
    assert a.prior == b.prior and (a.weights == b.weights).all()


def test_without_usable_labels(spark, tables):
    docs, labels, _, n = tables
    for some in (labels.where("false"), labels.where("quality = 0 and toxic = 0")):
        assert quality_pu.quality_scores(docs, some).count() == n
        assert toxicity.toxicity_scores(docs, some).count() == n
    assert quality_pu.quality_scores(docs.where("false"), labels).collect() == []
    assert toxicity.toxicity_scores(docs.where("false"), labels).collect() == []


def test_keep_good_keeps_columns(tables):
    docs, labels, known, _ = tables
    model = quality_pu.train(docs, labels)
    kept = quality_pu.keep_good(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = [i for i, (q, _) in known.items() if q]
    assert len(ids & set(good)) > 0.97 * len(good) and len(ids & set(known)) < 1.05 * len(good)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"", b"One two TWO.", b" ", "é | x$$".encode(), b"a\nb c"]
    whole = text_features.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for t, row in zip(texts, whole, strict=True):
        alone = text_features.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], row) and np.isfinite(row).all()


def test_grammar_scores_clauses():
    machine = toxicity.matcher({"idiot": 2.0})
    kinds = lambda text: {k for k, v in zip(toxicity.KINDS, toxicity.describe(text, machine), strict=False) if v}
    assert kinds("What an idiot.") == {"insult"}
    assert kinds("You are an Idiots") == {"aimed insult"}
    assert kinds("he is not an idiot") == {"negated insult"}
    assert kinds("They said you are an idiot") == {"reported insult"}
    assert kinds("They said so, you idiot") == {"aimed insult"}
    assert kinds("I will find you and kill them") == {"aimed threat"}
    assert kinds("never kill you") == set() and kinds("nonidiot") == set() and kinds("") == set()
    assert kinds("not here, idiot; you idiot") == {"insult", "aimed insult"}


def test_composed_machine_is_the_five_machines_in_turn():
    """Every clause of up to five symbols: the same symbols out and the same weight as through one machine after another."""
    for n in range(1, 6):
        for clause in itertools.product(toxicity._SYMBOLS, repeat=n):
            state, states, weight, plain = 0, [0] * len(toxicity.MACHINES), 0.0, 0.0
            for symbol in clause:
                state, out, w = toxicity.GRAMMAR.step(state, symbol)
                weight += w
                for i, machine in enumerate(toxicity.MACHINES):
                    states[i], symbol, w = machine.step(states[i], symbol)
                    plain += w
                assert out == symbol
            assert weight == plain


def test_weights_of_patterns():
    machine = toxicity.matcher({"idiot": 2.0})
    weight = lambda kind, text: float(np.expm1(toxicity.describe(text, machine)[toxicity.KINDS.index(kind)]))
    assert weight("aimed insult", "you idiot") == pytest.approx(2.0)
    assert weight("aimed insult", "you total idiot") == pytest.approx(2.0 + toxicity.INTENSE)
    assert weight("aimed insult", "you total and idiot") == pytest.approx(2.0)
    assert weight("aimed threat", "they kill") == pytest.approx(toxicity.THREAT_WEIGHT)
    assert weight("aimed threat", "I will find you and kill") == pytest.approx(toxicity.THREAT_WEIGHT + toxicity.ANNOUNCED)
    assert weight("threat", "Kill them") == pytest.approx(toxicity.THREAT_WEIGHT + toxicity.IMPERATIVE)
    assert weight("negated insult", "not a very idiot") == pytest.approx(2.0 + toxicity.INTENSE)
    assert not any(toxicity.describe("I will not kill you", machine)[:len(toxicity.KINDS)])


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if url is not None and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_rules_and_parts(spark):
    hosts = ["example.net", "A.example.NET", "net", "x.org", "notexample.com", "m.example.com", "example.com:80", "ÉX.net", "", "a\nb.net"]
    tails = ["", "/", "/en/", "/en", "/de/x?y=/fr/", "/fr/#a?b", "?/de/", "#/", "/a//b", "/en/\nz"]
    urls = [s + h + t for s in ("http://", "HTTPS://", "", "a://b://") for h in hosts for t in tails] + [None, "://", "x", ""]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, html string, path string")
    out = url_filter.judge(pages, URL_RULES)
    assert out.count() == len(urls) and "Python" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        host, path, (rule, verdict) = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.where("false"), URL_RULES).collect() == []


def test_trees_learn_from_given_labels(spark):
    r = random.Random(3)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    bad = [f"http://{name()}-{r.randint(1000, 9999)}.xyz/{r.randint(1, 10**9)}?a=1&b=2&c={r.randint(1, 10**9)}" for _ in range(200)]
    good = [f"http://www.{name()}.info/{name()}/{name()}" for _ in range(200)]
    labelled = spark.createDataFrame([(u, 1) for u in bad[:150]] + [(u, 0) for u in good[:150]] + [(None, 1), ("x", None)], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad[150:] + good[150:])], "page_id long, url string")
    got = {p["page_id"]: p["verdict"] for p in url_filter.judge(pages, [], labelled).collect()}
    assert sum(got[i] == ("block" if i < 50 else "allow") for i in got) > 95


def test_every_suffix_has_its_statistics(spark):
    n = 10_050
    labelled = spark.range(n).select(F.format_string("http://h%05d.example/", "id").alias("url"), F.lit(1.0).alias("label"))
    known = url_filter.with_features(url_filter.with_parts(labelled))
    stats = [url_filter.suffix_statistics(known, level) for level in (1, 2, 3)]
    got = url_filter._with_suffixes(known, stats)
    assert stats[1].count() == n and got.count() == n
    assert got.where("seen_2 = 0 or seen_3 = 0 or rate_2 = 0.5").count() == 0
