"""Byte-level BPE encoding and decoding.

Words are the space-delimited chunks of ``encoding``; a corpus has few that are frequent. All words of all texts are counted,
and the most frequent ones, at most ``FREQUENT``, are encoded by Spark's higher-order functions: the public pattern cuts a word into
pieces, a piece becomes an array of its bytes (as hex), and ``aggregate`` folds over it, each step joining the adjacent pair
of least rank, leftmost first, until no pair has a rank. The ranks stand in the plan as one literal, an array of small maps
addressed by the key's hash, so that a look-up is O(1). Decoding concatenates each id's bytes from a literal array.

The finished words (a table of at most FREQUENT rows and FREQUENT * ``WORD_CHARS`` characters, so it may be broadcast) serve the
documents' tasks. A task meets words that are not among them; those are folded in the task by the same ranked merges, many
words at once (``PairRanks``), and kept in a bounded cache. Sending rare words through a join with the whole dictionary instead gives the same rows; README
has the figures why it isn't done.

Defined cases: null text counts as empty and has no ids; any bytes that UTF-8 text can hold round-trip; repeated rows are
encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import attach_scalars
from .encoding import CACHED_UNITS, SLICE_BYTES, ChunkCoder, chunks, is_one_piece, units
from .shared import binary_views, byte_chunks, map_batches, staged, texts, worker_cache

FREQUENT, WORD_CHARS = 1 << 17, 64
SLOTS = 1 << 16
#: Tasks that fold the frequent words: an explicit count, since by its bytes so small a table would become one task.
FOLD_TASKS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankLiteral:
    """The rank map as a one-row table that ``attached`` gives to rows by scalar subquery: evaluated once and then a literal of
    the running plan, but not a text of several megabytes in every description of it. ``_slots`` holds ranks by hex
    key, ``_keys`` the keys by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
        keys: list[str | None] = [None] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            k = token.hex().upper()
            keys[r] = k
            slots[zlib.crc32(k.encode()) % SLOTS][k] = r
        self._json = json.dumps(slots, separators=(",", ":")), json.dumps(keys, separators=(",", ":"))

    def attached(self, words: DataFrame) -> DataFrame:
        row = words.sparkSession.createDataFrame([self._json], "slots string, keys string")
        return attach_scalars(words, row.select(F.from_json("slots", "array<map<string,int>>").alias("_slots"),
                                                F.from_json("keys", "array<string>").alias("_keys")))

    @staticmethod
    def rank(key: Column) -> Column:
        return F.try_element_at(F.get(F.col("_slots"), (F.crc32(key.cast("binary")) % SLOTS).cast("int")), key)

    @staticmethod
    def key(rank: Column) -> Column:
        return F.get(F.col("_keys"), rank)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_piece(piece: Column, literal: RankLiteral) -> Column:
    """Ids of one piece (a string) by ranked merges over its bytes."""
    def joined(parts: Column, at: Column) -> Column:
        pair = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
        return F.concat(F.slice(parts, F.lit(1), at - 1), pair, F.slice(parts, at + 2, F.size(parts)))

    def step(parts: Column, _: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                            lambda i: literal.rank(F.concat(F.get(parts, i - 1), F.get(parts, i))))
        least = _let(ranks, lambda r: _let(F.array_position(r, F.array_min(r)).cast("int"),
                                           lambda at: F.when(at.isNull(), parts).otherwise(joined(parts, at))))
        return F.when(F.size(parts) < 2, parts).otherwise(least)
    digits = F.hex(F.encode(piece, "UTF-8"))
    start = _let(digits, lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1),
                                               lambda i: F.substr(h, i * 2 + 1, F.lit(2))))
    return _let(start, lambda s: F.transform(F.aggregate(s, s, step), literal.rank))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, counted by slice before the shuffle. Words are chunks with a space before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in byte_chunks(batch, SLICE_BYTES):
                counted = chunks(data, off)[0].value_counts()
                found = [(c[1:].decode(), n) for c, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True)
                         if c[:1] == b" " and len(c) > 1]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                                                     ["word", "n"])
    return map_batches(texts(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(word, ids, decoded) of distinct words, each with the space before it, by higher-order functions. Words with a
    character that the JVM's Unicode tables don't know are left out."""
    literal = RankLiteral(ranks)
    known = words.where(~F.col("word").rlike(r"\p{Cn}"))
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), F.col("word")), F.lit("(?U)" + pattern), F.lit(0))
    ids = F.flatten(F.transform(pieces, lambda p: merge_piece(p, literal)))
    return (literal.attached(known.select("word")).withColumn("ids", ids)
            .withColumn("decoded", F.unhex(F.array_join(F.transform("ids", literal.key), ""))).select("word", "ids", "decoded"))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by ranked merges, least rank first, leftmost of equals."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    rank, none = ranks.get, len(ranks) + 1
    pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (least := min(pairs)) != none:
        at = pairs.index(least)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = rank(parts[at] + parts[at + 1], none)
        if at:
            pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
    return [ranks[p] for p in parts]


#: Longest piece that is folded together with others, and how many of them at once.
TOGETHER_BYTES, TOGETHER = 48, 1 << 14


class PairRanks:
    """The ranks of adjacent tokens as arrays, by which many pieces are merged at once: those of equal length are the rows of a matrix,
    and each round joins every row's pair of least rank, the leftmost of equals. A merged pair's id is its rank."""
    NONE = np.int32(2 ** 31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token))
                 if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.shift = np.uint64(64 - max(4, (2 * len(pairs)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.slots), self.NONE, np.int32)
        keys = (left << 32) | right
        at, todo = self._hash(keys), np.arange(len(keys))
        while len(todo):  # the first that comes to a free slot takes it, the others go on to the next one
            free = np.flatnonzero(self.slots[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[first]], self.values[at[first]] = keys[todo[first]], rank[todo[first]]
            left_over = np.ones(len(todo), bool)
            left_over[first] = False
            todo, at = todo[left_over], (at[left_over] + 1) & (len(self.slots) - 1)
        self.of_bytes = self.of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if their bytes are no token."""
        keys = (left.astype(np.int64) << 32) | right
        out, todo, at = np.full(len(keys), self.NONE, np.int32), np.arange(len(keys)), self._hash(keys)
        while len(todo):
            found = self.slots[at]
            hit = found == keys
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, at, keys = todo[on], (at[on] + 1) & (len(self.slots) - 1), keys[on]
        return out

    def _rounds(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of a matrix of bytes, as they are done."""
        rows, ids = np.arange(len(data)), self.byte_ids[data]
        ranks = self.of_bytes[data[:, :-1].astype(np.int32) * 256 + data[:, 1:]]
        while len(rows):
            if ids.shape[1] == 1:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            on = least != self.NONE
            if not on.all():
                yield rows[~on], ids[~on]
                rows, ids, ranks, at, least = rows[on], ids[on], ranks[on], at[on], least[on]
            column, place = np.arange(ids.shape[1]), np.arange(len(rows))
            ids = np.where(column[:-1] <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[place, at] = least
            ranks = np.where(column[:-2] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
            ranks[before, at[before] - 1] = self.of(ids[before, at[before] - 1], least[before])
            ranks[after, at[after]] = self.of(least[after], ids[after, at[after] + 1])

    def fold(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, each piece's first one and one end more): those of ``merge``, or one id where a piece is a token."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ids = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        whole = np.flatnonzero(ids >= 0)
        done.append((whole, ids[whole, None]))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size[whole] = 0
        for n in np.unique(size[size > 0]).tolist():
            group = np.flatnonzero(size == n)
            if n > TOGETHER_BYTES:
                for k in group.tolist():
                    merged = merge(pieces[k], self.ranks) if n <= 256 else merge_long(pieces[k], self.ranks)
                    done.append((np.array([k]), np.array([merged])))
                continue
            for a in range(0, len(group), TOGETHER):
                some = group[a:a + TOGETHER]
                data = np.frombuffer(b"".join([pieces[k] for k in some.tolist()]), np.uint8).reshape(-1, n)
                done += [(some[rows], found) for rows, found in self._rounds(data)]
        count = np.zeros(len(pieces) + 1, np.int64)
        for rows, found in done:
            count[rows + 1] = found.shape[1]
        first = count.cumsum()
        flat = np.zeros(first[-1], np.int32)
        for rows, found in done:
            flat[first[rows][:, None] + np.arange(found.shape[1])] = found
        return flat, first


class Values:
    """What is kept of a chunk: its ids as unsigned 32-bit integers or in decimal, each with a space after it, and the bytes they decode to."""

    def __init__(self, ranks: dict[bytes, int], decimal: bool):
        token: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for k, r in ranks.items():
            token[r] = k
        self.token = pa.array(token, pa.large_binary())
        self.decimal = pa.array([b"%d " % i for i in range(len(token))], pa.large_binary()) if decimal else None

    def of(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[bytes, bytes]]:
        """The values of runs of ids; ``first``: each run's first id and one end more."""
        at = pa.array(ids, pa.int32())
        return list(zip(self._cut(self.decimal, at, first) if self.decimal is not None else _slices(ids.astype("<u4").tobytes(), 4 * first),
                        self._cut(self.token, at, first), strict=True))

    @staticmethod
    def _cut(values: pa.Array, at: pa.Array, first: np.ndarray) -> list[bytes]:
        data, places = binary_views(values.take(at))
        return _slices(data.tobytes(), places[first])


def _slices(data: bytes, cuts: np.ndarray) -> list[bytes]:
    ends = cuts.tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Encoder:
    """What tasks get: the rank map, the pattern and the frequent words' finished values (word, ids, decoded)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, frequent: pa.Table):
        self.ranks, self.pattern, self.frequent = ranks, pattern, frequent

    def coder(self, decimal: bool = False) -> ChunkCoder:
        import regex
        cut, pairs, values = regex.compile(self.pattern), PairRanks(self.ranks), Values(self.ranks, decimal)
        listed = self.frequent.column("ids").combine_chunks()
        first = np.append(0, np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
        found = values.of(listed.flatten().to_numpy(zero_copy_only=False).astype(np.int32), first)
        frequent = {b" " + w.encode(): (ids, d) for w, (ids, _), d in zip(
            self.frequent.column("word").to_pylist(), found, self.frequent.column("decoded").to_pylist(), strict=True)}
        done: dict[str, tuple[bytes, bytes]] = {}

        def of_units(fresh: list[str]) -> list[tuple[bytes, bytes]]:
            pieces, ends = [], [0]
            for u in fresh:
                if is_one_piece(u):
                    pieces.append(u.encode())
                else:
                    pieces += [p.encode() for p in cut.findall(u)]
                ends.append(len(pieces))
            ids, first = pairs.fold(pieces)
            return values.of(ids, first[ends])

        def encode(chunks: list[str]) -> list[tuple[bytes, bytes]]:
            if len(done) >= CACHED_UNITS:
                done.clear()
            out: list = [None] * len(chunks)
            alone, several, fresh = [], [], {}
            for k, chunk in enumerate(chunks):
                parts = (chunk,) if is_one_piece(chunk) else units(chunk)
                if len(parts) == 1:
                    alone.append(k)
                else:
                    several.append((k, parts))
                    fresh.update((u, None) for u in parts if u not in done and not (u[0] == " " and u.encode() in frequent))
            for k, v in zip(alone, of_units([chunks[k] for k in alone]), strict=True):
                out[k] = v
            fresh = dict(zip(fresh, of_units(list(fresh)), strict=True))
            for k, parts in several:
                parts = [fresh.get(u) or done.get(u) or frequent[u.encode()] for u in parts]
                out[k] = tuple(b"".join(x) for x in zip(*parts, strict=True)) if parts else (b"", b"")
            room = CACHED_UNITS - len(done)
            done.update((u, v) for u, v in list(fresh.items())[:room] if len(u) <= WORD_CHARS)
            return out
        return ChunkCoder(encode, 2, frequent)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge`` for long pieces: a heap of pairs over a linked list, n log n instead of n squared."""
    import heapq
    n = len(piece)
    token: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            pair = token[i] + token[after[i]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if token[i] is not None else n
        if j >= n or token[i] + token[j] != pair:
            continue
        token[i], token[j] = pair, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[t] for t in token if t is not None]


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words that are frequent enough for at most ``most`` of them to be so: a frequency limit from a histogram of
    counts (sixteen steps a doubling), not a sort."""
    words = counts.where(F.length("word").between(1, WORD_CHARS)).withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    total, limit = 0, None
    for r in words.groupBy("step").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect():  # 64 * 16 rows at most
        total += r["k"]
        if total > most:
            break
        limit = r["step"]
    return words.where(F.lit(False) if limit is None else F.col("step") >= limit).select("word")


def make_encoder(docs: DataFrame, ranks_path: str, pattern: str, frequent: int = FREQUENT) -> Encoder:
    ranks = read_ranks(ranks_path)
    words = frequent_words(staged(word_counts(docs), "word-counts"), frequent)
    return Encoder(ranks, pattern, encode_words(words.repartition(FOLD_TASKS, "word"), ranks, pattern).toArrow())


_CODER: dict[str, ChunkCoder] = worker_cache({})


def _map_encoded(docs: DataFrame, encoder: Encoder, make: Callable, schema: str) -> DataFrame:
    """``make`` of a row's doc_id, its ids (bytes, as the digest or the encoding keeps them) and the bytes they decode to, for every row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(encoder), uuid.uuid4().hex
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODER:
            _CODER[key] = shared.value.coder(schema == DIGEST)
        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for ids, decoded in _CODER[key].columns(batch.column("body")):
                rows = [make(next(doc_ids), i, d) for i, d in zip(ids, decoded, strict=True)]
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=_ARROW[schema])
    return map_batches(texts(docs), run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string"
_SHA = ("decoded_sha256", pa.string())
_ARROW = {DIGEST: pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), _SHA]),
          ENCODED: pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), _SHA])}


def digest(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of ``docs``."""
    def make(doc_id: int | None, ids: memoryview, decoded: memoryview) -> tuple:
        return doc_id, bytes(ids).count(b" "), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest()
    return _map_encoded(docs, encoder, make, DIGEST)


def encode(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row for each row of ``docs``; the digest is that of the bytes which the ids decode to."""
    def make(doc_id: int | None, listed: memoryview, decoded: memoryview) -> tuple:
        ids = np.frombuffer(listed, "<i4")
        return doc_id, len(ids), ids, hashlib.sha256(decoded).hexdigest()
    return _map_encoded(docs, encoder, make, ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), the ids' byte pieces concatenated."""
    shared = encoded.sparkSession.sparkContext.broadcast({r: k for k, r in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value
        for batch in batches:
            text = [b"".join([token[i] for i in ids or []]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])
    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
