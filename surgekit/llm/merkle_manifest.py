"""Merkle dataset manifest: digests of all rows, climbed from every leaf by a recursive query.

A row's leaf is the digest of its fields. The leaves of each source, by doc_id, are grouped in runs of ``FAN`` consecutive nodes whose
digest is the node above, until one node is left: the source's subroot. Subroots, by source, likewise give the root.

1. *Levels.* Leaves are numbered within their source by a range sort, so a node's run is its number divided by ``FAN`` and a hot
   source is many small groups. Each level is written as rows (tree, level, idx) with a link to the parent and the digests of the
   node's siblings to its left and right; the topmost node of a source's tree is the leaf of the root's tree (``ROOT_TREE``).
2. *Climb.* A recursive query ascends along the parent links. The leaves of one run meet the same nodes above it, so they climb as
   one row: each leaf keeps the digest folded so far, and the siblings that are appended to their common proof are held once. A
   step joins the rows with the nodes where they stand, appends the siblings and folds every leaf's digest with them, until the root.
   Rows number a sixteenth of the leaves, and so do the nodes; digests travel as 32 bytes, and what only the end needs (doc_id, leaf)
   stays behind and is joined to the finished climb.

Tampered leaves have their text's A-Z lower-cased where ``TAMPER_MODULUS`` divides the crc32 of the doc_id; their fold differs from the
root exactly if the text had such letters.

Defined cases: null fields count as ``-``; a null source is a source of its own and comes first; a null doc_id comes first and is not
tampered; rows with equal doc_id follow by their leaf; a lone leaf is its source's subroot, a lone subroot the root, and a proof
without siblings is the digest of nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered, staged

FAN = 16
ROOT_TREE = -1
TAMPER_MODULUS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def raw(hexed: Column) -> Column:
    return F.unhex(hexed)


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, changed): ``changed`` is the tampered leaf, null where the row is not tampered."""
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0
    lower = F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower())
    return docs.select(*FIELDS).select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
                                       digest(*head, field(F.col("text"))).alias("leaf"),
                                       F.when(tampered, digest(*head, field(lower))).alias("changed"))


def _placed(rows: DataFrame) -> DataFrame:
    """Leaves with their tree (the source's place among the sources), its size ``n`` and their place ``idx`` in it."""
    rows = numbered(rows, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "merkle-leaves")
    trees = staged(rows.groupBy("source").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    trees = numbered(trees, [F.col("source").asc_nulls_first()], "merkle-trees").select(
        F.col("source").alias("_source"), F.col("number").alias("tree"), "first", "n")
    return rows.join(trees, F.col("source").eqNullSafe(F.col("_source"))).withColumn("idx", F.col("number") - F.col("first")).select(
        "tree", "n", "idx", "doc_id", "leaf", "changed")


def _key(tree: Column, level: Column, idx: Column, n: Column) -> list[Column]:
    """The key of a node of a level of ``n`` nodes; a source's topmost node is a leaf of the root's tree."""
    top = (n == 1) & (tree != ROOT_TREE)
    return [F.when(top, F.lit(ROOT_TREE)).otherwise(tree).cast("long"), F.when(top, F.lit(0)).otherwise(level).cast("int"),
            F.when(top, tree).otherwise(idx).cast("long")]


def _above(n: Column) -> Column:
    return F.ceil(n / F.lit(FAN)).cast("long")


def _run(idx: Column) -> Column:
    return F.floor(idx / F.lit(FAN)).cast("long")


def _bundles(placed: DataFrame) -> DataFrame:
    """Runs of leaves: (tree, n, idx) of the node above them (a lone leaf is that node), its hash, the members (doc_id, leaf) and
    their folded digests as bytes; at most ``FAN`` members a row."""
    held = F.array_sort(F.collect_list(F.struct("idx", "doc_id", "leaf", "changed")))
    runs = placed.groupBy("tree", F.col("n").alias("size"), _run(F.col("idx")).alias("run")).agg(held.alias("held"))
    lone = F.col("size") == 1
    fold = F.transform("held", lambda m, i: raw(
        F.when(lone, F.coalesce(m.changed, m.leaf)).otherwise(digest(
            F.concat_ws("", F.slice(F.col("held.leaf"), F.lit(1), i)), F.coalesce(m.changed, m.leaf),
            F.concat_ws("", F.slice(F.col("held.leaf"), i + 2, F.lit(FAN)))))))
    return runs.select("tree", _above(F.col("size")).alias("n"), F.col("run").alias("idx"),
                       F.when(lone, F.element_at("held.leaf", 1)).otherwise(digest(F.concat_ws("", "held.leaf"))).alias("hash"),
                       F.transform("held", lambda m: F.struct(m.doc_id.alias("doc_id"), m.leaf.alias("leaf"))).alias("members"),
                       fold.alias("folds"))


def _level(rows: DataFrame, level: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(node rows of a level with parent link and siblings, the rows of the level above) of rows (tree, n, idx, hash), n > 1."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    runs = staged(rows.where("n > 1").groupBy("tree", "n", _run(F.col("idx")).alias("run")).agg(kids.alias("kids")), name)
    hashes = F.col("kids.hash")
    nodes = runs.select("tree", "n", "run", "kids", F.posexplode("kids").alias("at", "kid")).select(
        "tree", F.lit(level).alias("level"), F.col("kid.idx").alias("idx"),
        *(c.alias(k) for c, k in zip(_key(F.col("tree"), F.lit(level + 1), F.col("run"), _above(F.col("n"))),
                                     ("up_tree", "up_level", "up_idx"), strict=True)),
        raw(F.concat_ws("", F.slice(hashes, F.lit(1), F.col("at")))).alias("before"),
        raw(F.concat_ws("", F.slice(hashes, F.col("at") + 2, F.lit(FAN)))).alias("after"))
    above = runs.select("tree", _above(F.col("n")).alias("n"), F.col("run").alias("idx"), digest(F.concat_ws("", hashes)).alias("hash"))
    return nodes, above


def _levels(rows: DataFrame, n: int, level: int, name: str) -> tuple[list[DataFrame], list[DataFrame], int]:
    """All levels from ``level`` up, where the largest tree has ``n`` nodes: (node rows, rows with n = 1, the topmost level)."""
    nodes, tops = [], [rows.where("n = 1")]
    while n > 1:
        found, rows = _level(rows, level, f"{name}-{level}")
        nodes.append(found)
        tops.append(rows.where("n = 1"))
        n, level = -(-n // FAN), level + 1
    return nodes, tops, level


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


NODE_SCHEMA = "tree long, level int, idx long, up_tree long, up_level int, up_idx long, before binary, after binary"

CLIMB = """
WITH RECURSIVE climb(source_tree, run, tree, level, idx, folds, proof) AS (
  SELECT source_tree, run, tree, level, idx, folds, CAST('' AS BINARY) FROM {bundles}
  UNION ALL
  SELECT source_tree, run, up_tree, up_level, up_idx,
         transform(folds, f -> unhex(sha2(CAST(concat(left_hex, lower(hex(f)), right_hex) AS BINARY), 256))),
         concat(proof, before, after)
  FROM (SELECT c.source_tree, c.run, c.folds, c.proof, n.up_tree, n.up_level, n.up_idx, n.before, n.after,
               lower(hex(n.before)) AS left_hex, lower(hex(n.after)) AS right_hex
        FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx))
SELECT source_tree, run, folds, proof FROM climb WHERE tree = {tree} AND level = {level} AND idx = 0
"""


@contextlib.contextmanager
def _recursion_rows_unbounded(spark: SparkSession) -> Iterator[None]:
    """Spark stops a recursive query at a number of rows; a climb's rows are a sixteenth of the leaves a level."""
    key = "spark.sql.cteRecursionRowLimit"
    held = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, held)


class Manifest:
    """Built levels in the shared folder: bundles of leaves, node rows, subroots, the root and its key."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        placed = staged(_placed(leaves(docs)), "merkle-placed")
        size = placed.agg(F.max("n").alias("n"), F.max("tree").alias("last")).first()
        self.empty = size["n"] is None
        if self.empty:
            return
        bundles = staged(_bundles(placed), "merkle-bundles")
        nodes, tops, _ = _levels(bundles.drop("members", "folds"), -(-size["n"] // FAN), 1, "merkle-level")
        self.subroots = staged(_union(tops).select("tree", "hash"), "merkle-subroots")
        n_trees = size["last"] + 1
        rows = self.subroots.select(F.lit(ROOT_TREE).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"),
                                    F.col("tree").alias("idx"), "hash")
        upper, top, self.root_level = _levels(rows, n_trees, 0, "merkle-root")
        self.root = _union(top).first()["hash"]
        links = nodes + upper
        self.nodes = staged(_union(links), "merkle-nodes") if links else spark.createDataFrame([], NODE_SCHEMA)
        key = _key(F.col("tree"), F.lit(1), F.col("idx"), F.col("n"))
        self.bundles = bundles.select(F.col("tree").alias("source_tree"), F.col("idx").alias("run"),
                                      *(c.alias(k) for c, k in zip(key, ("tree", "level", "idx"), strict=True)), "folds")
        self.members = bundles.select(F.col("tree").alias("source_tree"), F.col("idx").alias("run"), "members")

    def climb(self) -> DataFrame:
        """(source_tree, run, folds, proof) of every run of leaves at the root, written to the shared folder."""
        spark = self.bundles.sparkSession
        with _recursion_rows_unbounded(spark):
            rows = spark.sql(CLIMB, bundles=self.bundles, nodes=self.nodes, tree=ROOT_TREE, level=self.root_level)
            return staged(rows, "merkle-climb")


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of ``docs``."""
    manifest = Manifest(docs)
    if manifest.empty:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    subroots = manifest.subroots.select(F.col("tree").alias("source_tree"), F.col("hash").alias("subroot"))
    rows = manifest.climb().join(manifest.members, ["source_tree", "run"]).join(subroots, "source_tree")
    leaf = F.col("members.leaf")
    siblings = F.concat_ws("", F.slice(leaf, F.lit(1), F.col("at")), F.slice(leaf, F.col("at") + 2, F.lit(FAN)))
    each = rows.select("members", "folds", "proof", "subroot", F.posexplode("members").alias("at", "m"))
    each = each.withColumn("folded_root", hexed(F.get("folds", F.col("at")))).withColumn("root", F.lit(manifest.root))
    return each.select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.leaf").alias("leaf"), "subroot", "root",
        digest(siblings, hexed(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
