"""URL filter with DataFrame functions only: longest-rule verdicts, and gradient-boosted trees over lexical features for
the urls that no rule decides.

The trees (MLlib's GBTClassifier) learn from labelled urls: those of ``labelled`` (url, label 1 = block), or, where none
are given, the judged urls with weak labels: the rule's verdict, else block for a host with a word of ``SEED_WORDS``, else
allow. Features: lengths of url, host, path and query, depth, digit ratio,
character entropy, parameter and hyphen counts, host labels, an IP-like host, and suffix statistics: the smoothed block
rate and the log count of the url's last one, two and three host labels among the labelled urls. Fitting uses at
most ``FIT_ROWS`` labelled urls in hash order. The suffix statistics hold every suffix; they are joined to the distinct
hosts, and the hosts to the rows, by plain equi-joins, so that the rows are shuffled once.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and a verdict from the method; empty
host or path parts stay empty; ports and user names count as part of the host; repeated rows are judged each; with labels
of one class only, or none, every undecided url is allowed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 20_000
TREES, DEPTH = 20, 4
SMOOTH = 5.0

#: Host words of advertising, gambling and junk sites, for weak labels.
SEED_WORDS = ("ads", "adserver", "bet", "bets", "casino", "click", "clickbait", "coupon", "farm", "lottery", "payday", "pills",
              "poker", "porn", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "win", "xxx")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_len", "host_len", "path_len", "query_len", "depth", "digit_ratio", "entropy", "params", "hyphens", "host_labels",
            "ip_like", "rate_1", "rate_2", "rate_3", "seen_1", "seen_2", "seen_3"]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path as the rules read them, and rest (all that follows ``://``)."""
    u = F.col(url)
    at = F.locate("://", u)
    rest = F.when(u.isNotNull() & (at > 0), F.expr("substring(__u, locate('://', __u) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("__rest", r"\A([^/?#]*)", 1)
    return (df.withColumn("__u", u).withColumn("__rest", rest).withColumn("host", F.translate(host, UPPER, LOWER))
            .withColumn("path", F.expr(r"regexp_extract(substring(__rest, length(host) + 1), '\\A([^?#]*)', 1)")).drop("__u"))


def rule_of(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, then path) that fits host and path, as struct(rule, verdict), else null."""
    best = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True)
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in best]
    made = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in best]
    return F.coalesce(*(F.when(c, m) for c, m in zip(fits, made, strict=True))) if best else F.lit(None).cast(
        "struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of the 40 characters that urls are made of (others as one class)."""
    chars = LOWER + "0123456789-._/"
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    low = F.lower(text)
    counts = [F.length(text) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in chars]
    other = F.length(F.translate(low, chars, ""))
    return -reduce(lambda a, b: a + b, [F.when(k > 0, (k / n) * F.log2(k / n)).otherwise(0.0) for k in [*counts, other]])


def with_features(df: DataFrame) -> DataFrame:
    """Adds the features that one url gives, and its two suffixes; expects what ``with_parts`` adds."""
    query = F.regexp_extract("__rest", r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    digits = F.length(F.regexp_replace("__rest", "[^0-9]", ""))
    return (df.withColumn("url_len", F.length("__rest").cast("double")).withColumn("host_len", F.length("host").cast("double"))
            .withColumn("path_len", F.length("path").cast("double")).withColumn("query_len", F.length(query).cast("double"))
            .withColumn("depth", F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"))
            .withColumn("digit_ratio", digits / F.greatest(F.length("__rest"), F.lit(1)))
            .withColumn("entropy", _entropy(F.col("__rest")))
            .withColumn("params", F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")))
            .withColumn("hyphens", (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"))
            .withColumn("host_labels", F.size(labels).cast("double"))
            .withColumn("ip_like", F.col("host").rlike(r"\A[0-9.]+(:[0-9]+)?\z").cast("double"))
            .withColumn("suffix_1", F.element_at(labels, -1))
            .withColumn("suffix_2", F.substring_index("host", ".", -2))
            .withColumn("suffix_3", F.substring_index("host", ".", -3)))


def suffix_statistics(labelled: DataFrame, level: int) -> DataFrame:
    """(suffix, block rate drawn towards one half, log count) of every suffix of labelled urls."""
    key = f"suffix_{level}"
    return (labelled.groupBy(key).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
            .select(key, ((F.col("b") + SMOOTH / 2) / (F.col("n") + SMOOTH)).alias(f"rate_{level}"), F.log1p("n").alias(f"seen_{level}")))


def _with_suffixes(df: DataFrame, stats: list[DataFrame]) -> DataFrame:
    """Adds the statistics of the three suffixes; those of a suffix without labelled urls are 0.5 and 0."""
    hosts = df.select("host", "suffix_1", "suffix_2", "suffix_3").distinct()
    for level, s in enumerate(stats, 1):
        hosts = hosts.join(s, f"suffix_{level}", "left").fillna({f"rate_{level}": 0.5, f"seen_{level}": 0.0})
    return df.join(hosts.drop("suffix_1", "suffix_2", "suffix_3"), "host", "left")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None,
          fit_rows: int = FIT_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row of ``pages``."""
    ruled = with_parts(pages.select("page_id", "url")).withColumn("__r", rule_of(rules))
    if labelled is None:
        words = F.split("host", "[^a-z0-9]+")
        weak = F.coalesce(F.col("__r.verdict") == "block", F.arrays_overlap(words, F.array(*map(F.lit, SEED_WORDS))))
        known = ruled.where("url is not null").withColumn("label", weak.cast("double"))
    else:
        known = with_parts(labelled.select("url", F.col("label").cast("double").alias("label")).where("label is not null"))
    known = with_features(known.select("url", "__rest", "host", "path", "label"))
    stats = [suffix_statistics(known, level) for level in (1, 2, 3)]
    order = [F.xxhash64("url", F.lit(5)), F.col("url")]
    sample = (_with_suffixes(known.orderBy(*order).limit(fit_rows), stats).orderBy(*order).limit(fit_rows)
              .select("label", *FEATURES))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = vector.transform(sample).select("label", "features")
    classes = {r["label"] for r in train.select("label").distinct().collect()}
    rows = with_features(ruled)
    if classes == {0.0, 1.0}:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.2, seed=7, cacheNodeIds=False).fit(train)
        rows = model.transform(vector.transform(_with_suffixes(rows, stats)))
        rows = rows.withColumn("block_score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("block_score", F.lit(0.0))
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("__r.rule").alias("rule"),
                       F.coalesce(F.col("__r.verdict"), learned).alias("verdict"), "block_score")
