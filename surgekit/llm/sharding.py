"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. All documents go into shards of nearly equal bytes (law ``bytes``; a document's size is that of its
text and one more), and linked documents should share a shard.

1. *Start.* Linked documents get labels (shards) that are balanced but otherwise random.
2. *Rounds.* Links are held as stars: a document is joined to its text, so a group of k copies has k links. Each round counts every text's
   documents by shard (a hot text becomes at most ``shards`` rows), and documents ask to move where most of their copies are,
   among shards with room. A shard admits movers up to its capacity, a fair share of all bytes less what it holds: movers are summed in
   ``CELLS`` hash cells a shard, and cells are admitted in order as long as they fit. A text's documents share a cell and so move
   together; one of more than a ``HEAVY``-th of the capacity is spread over all cells, fills a shard and goes on to the next. Rounds
   end when nobody moves, or after ``ROUNDS``; the law holds after each.
3. *Fill.* Documents without links even out the sizes: they are summed in ``FILL_CELLS`` hash cells, the largest cell goes to the
   emptiest shard first.

What the driver sees has a fixed size: shards x cells sums. A shard differs from the mean by about one fill cell or one document.

Defined cases: null text counts as empty; empty texts are equal texts; repeated rows and null doc_ids are rows like others; a text that
is larger than a fair share makes its shard larger by as much; with fewer rows than shards some stay empty; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

SHARDS, CELLS, FILL_CELLS, HEAVY, ROUNDS = 16, 1024, 1 << 14, 64, 16


def _rows(docs: DataFrame) -> DataFrame:
    """(row, part, doc_id, size, text_crc32, name): ``name`` is the text's digest, ``part`` a row's partition."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", body.alias("body")).select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length("body") + 1).cast("long").alias("size"), F.crc32(F.col("body").cast("binary")).alias("text_crc32"),
        F.unhex(F.md5("body")).alias("name"))
    return staged(rows, "shard-rows")


def _cell(value: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(cells)).cast("int")


def _spread(sizes: dict[int, int], cells: int, loads: list[int]) -> list[int]:
    """A shard for each cell: the largest cell to the emptiest shard first. ``loads`` is brought up to date."""
    out = [k % len(loads) for k in range(cells)]
    free = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(free)
    for cell, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(free)
        out[cell] = s
        loads[s] = load + size
        heapq.heappush(free, (loads[s], s))
    return out


def _by_cell(rows: DataFrame, cells: int, loads: list[int]) -> Column:
    """The shard of rows by their cell, so that the shards' loads become even."""
    sizes = {r["cell"]: r["size"] for r in rows.groupBy("cell").agg(F.sum("size").alias("size")).collect()}  # at most ``cells`` rows
    return F.get(F.from_json(F.lit(json.dumps(_spread(sizes, cells, loads))), "array<int>"), F.col("cell"))


def _admitted(asked: dict[tuple[int, int], int], room: list[int], shards: int) -> list[int]:
    """For each shard how many cells, in order, fit into its room."""
    out = []
    for s in range(shards):
        held, cut = 0, 0
        while cut < CELLS and held + asked.get((s, cut), 0) <= max(0, room[s]):
            held += asked.get((s, cut), 0)
            cut += 1
        out.append(cut)
    return out


def propagate(linked: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(``linked`` with its last labels, rounds run); ``linked`` has (name, size, cell, shard) among its columns. ``capacity``: bytes
    that linked documents may fill in a shard."""
    for turn in range(rounds):
        held = staged(linked.groupBy("name", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "shard-counts")
        loads = [0] * shards
        for r in held.groupBy("shard").agg(F.sum("size").alias("size")).collect():  # a row a shard
            loads[r["shard"]] = r["size"]
        room = [capacity - x for x in loads]
        open_shards = [s for s in range(shards) if room[s] > 0]
        pull = F.struct("n", F.xxhash64("name", "shard").alias("tie"), "shard")
        ranked = held.select("name", "shard", pull.alias("pull"))
        best = ranked.where(F.col("shard").isin(open_shards)).groupBy("name").agg(F.max("pull").alias("best"))
        moves = ranked.join(best, "name").where(F.col("pull") < F.col("best")).select("name", "shard", F.col("best.shard").alias("to"))
        turned = F.pmod(F.col("cell") + F.lit(turn * 389), F.lit(CELLS))  # each round begins with other cells
        asking = staged(linked.join(moves, ["name", "shard"], "left").withColumn("place", turned), "shard-asking")
        sums = asking.where("to is not null").groupBy("to", "place").agg(F.sum("size").alias("size"))
        asked = {(r["to"], r["place"]): r["size"] for r in sums.collect()}  # shards x CELLS rows
        cut = _admitted(asked, room, shards)
        if not any(place < cut[s] for s, place in asked):
            return asking.drop("to", "place"), turn
        fits = F.col("place") < F.get(F.array(*map(F.lit, cut)), F.col("to"))
        linked = asking.withColumn("shard", F.when(fits, F.col("to")).otherwise(F.col("shard"))).drop("to", "place")
    return linked, rounds


def place(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, part, doc_id, size, text_crc32, name, shard), a row for each row of ``docs``, written to the shared folder."""
    rows = _rows(docs)
    groups = rows.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("group_size")).where("copies > 1")
    groups = staged(groups, "shard-groups")  # its own exchange in the join, so that Spark can split a hot text's rows
    rows = staged(rows.join(groups, "name", "left"), "shard-linked")
    total, = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = total // shards
    heavy = F.col("group_size") * HEAVY > capacity
    linked = rows.where("copies is not null").withColumn("cell", _cell(F.col("row"), FILL_CELLS))
    linked = linked.withColumn("shard", _by_cell(linked, FILL_CELLS, [0] * shards))
    linked = linked.withColumn("cell", F.when(heavy, _cell(F.col("row"), CELLS)).otherwise(_cell(F.col("name"), CELLS)))
    linked, _ = propagate(linked.drop("copies", "group_size"), capacity, shards, rounds)
    linked = staged(linked.drop("cell"), "shard-labels")
    loads = [0] * shards
    for r in linked.groupBy("shard").agg(F.sum("size").alias("size")).collect():  # a row a shard
        loads[r["shard"]] = r["size"]
    alone = rows.where("copies is null").drop("copies", "group_size").withColumn("cell", _cell(F.col("row"), FILL_CELLS))
    alone = alone.withColumn("shard", _by_cell(alone, FILL_CELLS, loads)).drop("cell")
    return staged(linked.unionByName(alone), "shard-placed")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds ``slot``, from 0 without gaps in each shard: a row's place among those of its partition and shard, after the partitions
    before."""
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1
    return (placed.withColumn("local", local).join(offsets, ["part", "shard"])
            .withColumn("slot", (F.col("before") + F.col("local")).cast("long")).drop("before", "local"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of ``docs``."""
    return with_slots(place(docs, shards)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row (links, cut): links from each document to another of its text, and those that leave the shard with the most of
    the text's documents."""
    by_shard = placed.groupBy("name", "shard").agg(F.count(F.lit(1)).alias("n"))
    texts = by_shard.groupBy("name").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return texts.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("n") - F.col("most")).alias("cut"))
