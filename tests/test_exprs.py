"""Column functions on hand-made rows: nulls, zero denominators, every band boundary."""

from pyspark.sql import functions as F

from surgekit.functions import exprs as X


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_iso_duration_both_dialects(spark):
    cases = ["PT1H2M3S", "PT15M30S", "PT45S", "", None, "P1DT2H3M4S", "PT30S", "PT2M", "PT1.5S", "garbage"]
    rows = [(c,) for c in cases]
    lenient = one(spark, rows, "d string", X.iso_duration_lenient("d"))
    strict = one(spark, rows, "d string", X.iso_duration_strict("d"))
    assert lenient == [3723, 930, 45, 0, 0, 93784, 30, 120, 5, 0]
    assert strict == [3723, 930, 45, 0, 0, 93784, 30, 120, 0, 0]


def test_length_class_boundaries(spark):
    rows = [(s,) for s in (0, 60, 61, 600, 601, 1800, 1801)]
    assert one(spark, rows, "s long", X.length_class("s")) == [
        "shorts", "shorts", "short", "short", "medium", "medium", "long"]


def test_engagement_level(spark):
    rows = [(0, 10), (100, 5), (100, 2), (100, 1), (None, 3), (1000, None)]
    got = one(spark, rows, "v long, l long", X.engagement_level("l", "v"))
    assert got == ["low", "high", "medium", "low", "low", "low"]


def test_safe_div_and_surrogate_key(spark):
    df = spark.createDataFrame([(1, 0), (6, 3), (None, 2)], "a long, b long")
    assert [r[0] for r in df.select(X.safe_div("a", "b")).collect()] == [None, 2.0, None]
    k = spark.createDataFrame([("2001-01-01", 7)], "d string, c long").select(
        X.surrogate_key(F.col("d").cast("date"), "c")).first()[0]
    import hashlib
    assert k == hashlib.md5(b"2001-01-01-7").hexdigest()
    k2 = spark.createDataFrame([(None, 7)], "d string, c long").select(X.surrogate_key("d", "c")).first()[0]
    assert k2 == hashlib.md5(f"{X.SURROGATE_NULL_TOKEN}-7".encode()).hexdigest()


def test_url_key_and_number_format(spark):
    rows = [("dQw4w9WgXcQ",), ("https://youtu.be/abc123?t=4",), ("https://www.youtube.com/watch?v=xyz&list=1",),
            ("https://www.youtube.com/embed/qqq?x=1",), ("other",)]
    assert one(spark, rows, "u string", X.extract_url_key("u")) == ["dQw4w9WgXcQ", "abc123", "xyz", "qqq", "other"]
    nums = [(5,), (1500,), (2_500_000,), (3_200_000_000,)]
    assert one(spark, nums, "n long", X.compact_number("n")) == ["5", "2K", "2.5M", "3.2B"]


def test_priority_and_refresh(spark):
    rows = [("6000000", "10"), ("1000000", "10"), ("150000", "10"), ("20000", "10"), ("5", "10"), ("abc", "10"),
            ("5", "400")]
    pri = one(spark, rows, "s string, v string", X.crawl_priority(F.col("s")))
    ref = one(spark, rows, "s string, v string", X.refresh_hours("s", "v"))
    assert pri == [5, 4, 3, 2, 1, 1, 1]
    assert ref == [12, 12, 24, 48, 48, 24, 12]


def test_text_flags_and_counts(spark):
    rows = [("WOW this is 2 GOOD?! \U0001F600",), ("  plain   words ",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    fl = X.text_flags("t")
    got = df.select(*[c.alias(n) for n, c in fl.items()]).collect()
    assert got[0]["has_number"] == 1 and got[0]["has_question"] == 1 and got[0]["has_exclamation"] == 1
    assert got[0]["has_emoji"] == 1 and got[0]["has_caps_word"] == 1
    assert [g["title_word_count"] for g in got] == [len(r[0].split()) if r[0] else 0 for r in rows]
    tags = spark.createDataFrame([('["a","b"]',), ("[]",), (None,), ("  ",)], "t string")
    assert [r[0] for r in tags.select(X.comma_item_count("t")).collect()] == [2, 1, 0, 0]
