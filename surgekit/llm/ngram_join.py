"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two shingle sets link when ``den * |A and B| >= num * |A or B|``. With the shingles of every set in one global order, rarest
first, linked sets share a shingle within their prefixes: the first n - ceil(num/den * n) + 1 of the larger set, and the
first n - ceil(2 num/(num+den) * n) + 1 of the smaller one.

1. *Order.* Frequencies of all shingles of all texts are counted into 2**``BUCKET_BITS`` hash buckets (a table of fixed size,
   summed by a tree of tasks and broadcast). The order is (bucket count, hash): buckets with frequent shingles come last.
2. *Sets.* Equal sets become one node, which keeps its least doc_id. Nodes give prefix rows (shingle, node, size, place).
   Rows are range-sorted by shingle, and those without an equal neighbour are dropped.
3. *Links.* Only connected components are asked for, so a pair whose nodes are already connected is not compared again.
   First each row meets the pivots (least place in its prefix) of its shingle and of its size band and the band below: a
   group of k near copies costs about k comparisons. Then, in shingles whose nodes still lie in several components, all pairs across
   components meet, so no link is lost. Pairs pass the length filter, the positional filter, and a suffix filter (the
   overlap is at most the sum over ``CLASSES`` hash classes of the smaller class size); each pair that remains is verified
   once, on the two texts' full sets.

Defined cases: A-Z are lower-cased; null text counts as empty; a text without words has an empty set and is its own
component; with fewer words than a shingle has, the whole sequence is the one shingle; repeated rows share a node;
null doc_ids take part, and a component's id is its least doc_id that isn't null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import between, components
from .shared import byte_chunks, map_batches, staged, texts

BUCKET_BITS, SLICES = 20, 64
KNOWN_BYTES = 64 << 20
FAN_IN = 64
CLASSES = 64


def prefix_sizes(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix of the larger, prefix of the smaller) for sets of ``n`` shingles."""
    return n - -(-num * n // den) + 1, n - -(-2 * num * n // (num + den)) + 1


# ---- frequencies ----------------------------------------------------------------------------------------------------

def bucket_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many (document, shingle) pairs fall into each hash bucket, over all texts."""
    width = (1 << BUCKET_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, data, off in byte_chunks(batch):
                sets = hashing.shingles(data, off, size)
                h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                total += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        part = TaskContext.get().partitionId()
        yield _slices(part, {s: total[s * width:(s + 1) * width] for s in range(SLICES) if total[s * width:(s + 1) * width].any()})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for z in batch.column("z").to_pylist():
                total += np.frombuffer(zlib.decompress(z), "<i8")
        yield _slices(key[1].as_py(), {key[0].as_py(): total})
    schema = "slice int, part int, z binary"
    sums = staged(map_batches(rows, count, schema), "shingle-buckets")
    parts = sums.agg(F.max("part")).first()[0] or 0
    while parts > 0:  # a tree of sums, so that no task gets more than FAN_IN slices
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("slice", "part").applyInArrow(add, schema)
        parts //= FAN_IN
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in sums.collect():  # SLICES rows
        out[r["slice"] * width:(r["slice"] + 1) * width] += np.frombuffer(zlib.decompress(r["z"]), "<i8")
    return out


def _slices(part: int, counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    z = [zlib.compress(c.astype("<i8").tobytes(), 1) for c in counts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([part] * len(z), pa.int32()), pa.array(z, pa.binary())],
                                      ["slice", "part", "z"])


# ---- sets and their prefixes ----------------------------------------------------------------------------------------

def _named_sets(rows: DataFrame, size: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, h, g, n, s1, s2, prefix, short, classes, z): the text's 128-bit hash, then size, 128-bit name, rare-first prefix (``short``:
    how long it is in the role of the smaller set) and class sizes of its set, and the text packed."""
    shared = rows.sparkSession.sparkContext.broadcast(counts.astype("<i8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shared.value
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for a, b, data, off in byte_chunks(batch):
                view, cuts = memoryview(data), off.tolist()
                packed = [squeeze(view[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                sets = hashing.shingles(data, off, size)
                n = np.array([len(s) for s in sets], np.int64)
                long, short = prefix_sizes(n, num, den)
                names = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]
                prefixes, classes = [], []
                for s, k in zip(sets, long, strict=True):
                    rank = total[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    k = min(int(k), len(s))
                    if 0 < k < len(s):
                        near = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1])
                        order = near[np.lexsort((s[near], rank[near]))][:k]
                    else:
                        order = np.lexsort((s, rank))[:k]
                    prefixes.append(s[order].view(np.int64))
                    classes.append(np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "h", "g")), pa.array(n),
                     pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()),
                     pa.array(prefixes, pa.list_(pa.int64())), pa.array(np.minimum(short, n)), pa.array(classes, pa.list_(pa.int32())), pa.array(packed, pa.binary())],
                    ["doc_id", "h", "g", "n", "s1", "s2", "prefix", "short", "classes", "z"])
    return map_batches(rows, run, "doc_id long, h long, g long, n long, s1 long, s2 long, prefix array<long>, short long, classes array<int>, "
                       "z binary")


def _shared_shingles(prefixes: DataFrame) -> DataFrame:
    """The prefix rows whose shingle another row has too; of each range partition also the first and last row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None

        def kept(batch: pa.RecordBatch, after) -> pa.RecordBatch:
            t = batch.column("token").to_numpy()
            same = t[1:] == t[:-1]
            keep = np.concatenate(([before is None or before == t[0]], same)) | np.concatenate((same, [after is None or after == t[-1]]))
            return batch.filter(pa.array(keep))
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield kept(held, batch.column("token")[0].as_py())
                    before = held.column("token")[-1].as_py()
                held = batch
        if held is not None:
            yield kept(held, None)
    ordered = prefixes.repartitionByRange("token", "node").sortWithinPartitions("token", "node")
    return map_batches(ordered, run, "token long, node long, n long, pos int, short boolean")


# ---- pairs ----------------------------------------------------------------------------------------------------------

def _needed(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil(num * (a + b) / F.lit(float(num + den)) - 1e-9).cast("long")


def _may_link(num: int, den: int) -> Column:
    """Length and positional filter of a pair (x, y) that shares a shingle at these places; the smaller set's place must lie
    in its short prefix."""
    small, large = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    ahead = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    in_short = F.when(F.col("x_n") < F.col("y_n"), F.col("x_short")).when(F.col("x_n") > F.col("y_n"), F.col("y_short")).otherwise(
        F.col("x_short") | F.col("y_short"))
    return (den * small >= num * large) & (ahead >= _needed(F.col("x_n"), F.col("y_n"), num, den)) & in_short


def _side(df: DataFrame, name: str, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "pos", "short")))


def _distinct_pairs(met: DataFrame) -> DataFrame:
    return (met.select(F.least("x_node", "y_node").alias("u"), F.greatest("x_node", "y_node").alias("v")).where("u != v").distinct())


def _pivot_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Each row with the pivots of its shingle in its own size band and the one below. The pivot is the row whose set has the
    fewest rarer shingles: of a group of near copies the one closest to all others."""
    banded = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num) if num < den else F.lit(2.0))))
    pivots = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "node", "n", "short")).alias("p"))
    pivots = pivots.select("token", "band", *(F.col(f"p.{c}").alias(f"y_{c}") for c in ("node", "n", "pos", "short")))
    asked = _side(banded, "x", "token", "band").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    return _distinct_pairs(asked.join(pivots, ["token", "band"]).where("x_node != y_node").where(_may_link(num, den)))


def _open_pairs(rows: DataFrame, nodes: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs across components in the shingles that several components share. All three filters stand in the join's
    condition, so a large group of texts that nearly link makes comparisons in the join, but no rows."""
    placed = (rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("token")
    placed = staged(placed.join(mixed, "token").join(nodes.select("node", "classes"), "node"), "open-shingles")
    x = _side(placed, "x", "token", "component", "classes").withColumnRenamed("classes", "x_c")
    y = (_side(placed, "y", "token", "component", "classes").withColumnRenamed("classes", "y_c")
         .withColumnRenamed("component", "other"))
    met = x.join(y, "token").where("component != other and x_node < y_node").where(_may_link(num, den) & _classes_allow(num, den))
    return _distinct_pairs(met)


def _classes_allow(num: int, den: int) -> Column:
    """Suffix filter: the overlap is at most the sum of the smaller class sizes."""
    most = F.aggregate(F.zip_with("x_c", "y_c", lambda a, b: F.least(a, b)), F.lit(0), lambda s, k: s + k)
    return most >= _needed(F.col("x_n"), F.col("y_n"), num, den)


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    side = nodes.select("node", "n", "classes")
    x = side.select(F.col("node").alias("u"), F.col("n").alias("x_n"), F.col("classes").alias("x_c"))
    y = side.select(F.col("node").alias("v"), F.col("n").alias("y_n"), F.col("classes").alias("y_c"))
    return pairs.join(x, "u").join(y, "v").where(_classes_allow(num, den)).select("u", "v")


def _verified(pairs: DataFrame, bodies: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets link. ``bodies`` has (node, z)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()  # the last sets, of at most KNOWN_BYTES
        held = 0
        unpack = zstandard.ZstdDecompressor().decompress

        def sets(node: int, z) -> np.ndarray:
            nonlocal held
            if node not in known:
                body = unpack(z.as_py())
                known[node] = hashing.shingles(np.frombuffer(body, np.uint8), np.array([0, len(body)]), size)[0]
                held += known[node].nbytes
                while held > KNOWN_BYTES and len(known) > 1:
                    held -= known.popitem(last=False)[1].nbytes
            else:
                known.move_to_end(node)
            return known[node]
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            zu, zv = batch.column("zu"), batch.column("zv")
            good = []
            for i in range(len(u)):
                a, b = sets(u[i], zu[i]), sets(v[i], zv[i])
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))
    with_u = pairs.join(bodies.select(F.col("node").alias("u"), F.col("z").alias("zu")), "u")
    both = with_u.join(bodies.select(F.col("node").alias("v"), F.col("z").alias("zv")), "v")
    return map_batches(both.select("u", "v", "zu", "zv"), run, "u long, v long")


def text_hash(body: Column) -> list[Column]:
    """128 bits of a text: rows with equal ones hold the same text."""
    return [F.xxhash64(body).alias("h"), F.xxhash64(F.lit(1), body).alias("g")]


def _classes(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows' named sets, nodes with their component): the join itself."""
    rows = texts(docs).select("doc_id", "body", *text_hash(F.col("body")))
    named = _named_sets(rows, size, num, den, bucket_counts(rows, size)).withColumn("row", F.monotonically_increasing_id())
    named = staged(named, "shingle-sets")
    groups = (named.where("n > 0").groupBy("s1", "s2")
              .agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "g", "row")).alias("text"),
                   F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("short").alias("short"),
                   F.first("classes").alias("classes")))
    nodes = staged(groups.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    prefixes = nodes.select("node", "n", F.col("short").alias("k"), F.posexplode("prefix").alias("pos", "token")).select(
        "token", "node", "n", "pos", (F.col("pos") < F.col("k")).alias("short"))
    met = staged(_shared_shingles(prefixes), "shared-shingles")
    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = staged(_suffix_filter(pairs, nodes, num, den), f"{name}-pairs")
        asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        wanted = nodes.join(asked, "node").select("node", F.col("text.row").alias("row"))
        bodies = named.select("row", "z").join(wanted, "row").select("node", "z")
        return staged(_verified(pairs, staged(bodies, f"{name}-texts"), size, num, den), f"{name}-links")
    first = links(_pivot_pairs(met, num, den), "pivot")
    labels = staged(components(first), "pivot-components")
    second = links(_open_pairs(met, nodes, labels, num, den), "open")
    # the second links only join components of the first ones: their rounds run on components, not on all nodes again
    joined = components(between(second, labels)).select(F.col("node").alias("component"), F.col("component").alias("least_component"))
    placed = (nodes.select("s1", "s2", "node", "least", "text").join(labels, "node", "left")
              .withColumn("component", F.coalesce("component", "node")).join(joined, "component", "left")
              .withColumn("component", F.coalesce("least_component", "component")).drop("least_component"))
    return named, staged(placed, "placed-nodes")


def document_components(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    named, placed = _classes(docs, size, num, den)
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(ids, "component").select("s1", "s2", "component_id")
    return (named.select("doc_id", "n", "s1", "s2").join(found, ["s1", "s2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """One row of each class of linked documents, that of the least doc_id (a null doc_id counts as the greatest), with all
    its columns; rows without words stay."""
    named, placed = _classes(docs, size, num, den)
    keys = ["__id", "__no_id", "__h", "__g"]

    def keyed(df: DataFrame, doc_id: Column, h: Column, g: Column) -> DataFrame:
        return df.withColumns(dict(zip(keys, (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), h, g), strict=True)))
    chosen = placed.groupBy("component").agg(F.min("text").alias("t")).select(F.col("t.row").alias("row"))
    rows = named.select("doc_id", "h", "g", "row", "n")
    counts = keyed(rows, F.col("doc_id"), F.col("h"), F.col("g")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"))
    chosen = keyed(rows.join(chosen, "row"), F.col("doc_id"), F.col("h"), F.col("g")).select(*keys).join(counts, keys)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs_keyed = keyed(docs, F.col("doc_id").cast("long"), *text_hash(body))
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    met = docs_keyed.where(worded).join(chosen, keys)
    # only rows that repeat with their doc_id and text go through an aggregate
    kept = met.where("__copies = 1").unionByName(met.where("__copies > 1").dropDuplicates(keys)).drop("__copies")
    return kept.unionByName(docs_keyed.where(~worded)).select(*(F.col(f"`{c}`") for c in docs.columns))
