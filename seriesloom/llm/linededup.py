"""Operator 8: reversible line dedup by sharded cuckoo filters over exact reference counts.

`LineIndex` keeps, in the shared folder, an exact table (key, n_docs) of how many documents hold each line key, and a cuckoo filter
per shard of the keys that have reached `min_docs`. Inserting or deleting documents adds or subtracts their counts, and the filters
take in or delete exactly the keys that cross the threshold, so a deletion leaves the state that would have been had the document
never come. Applying it probes the filters first; what they pass is confirmed against the exact table, so a false positive costs
a lookup and never a line.

Counting is a Spark aggregate with partial counts, so a line that stands in a third of all documents is one row per task. The
number of shards is set by the first insertion, about SHARD_KEYS droppable keys each; a shard's keys stream to its task, sorted, and
fill its filter in bulk. Workers map the filters' files into memory. The exact droppable keys go to every task while there are at
most BROADCAST_KEYS; beyond it only the most frequent do, those above a number of documents that so many keys reach, and the lines
with a rarer key that pass the filters are joined with the exact table, where no key has a hot group any more.

Defined cases: a null or empty text is one empty line; an empty key is never dropped; a document whose lines all go keeps the
empty text; repeated rows are documents of their own (each counts); null doc_ids are ordinary; an empty table gives no rows;
other columns stay untouched in `apply`, and where one has an output's name, the output has "_" appended.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, LOWER, chunks, free_names, load, new_path, read_documents, remove, save, table

MIN_DOCS = 10
MIN_CHARS = 1
SHARDS, MOST_SHARDS, SHARD_KEYS = 16, 1 << 16, 500_000
#: Droppable keys of 16 bytes that are sent to the tasks.
BROADCAST_KEYS = 2_000_000
_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = LOWER.tobytes()
_UPPER_AZ, _LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key is the first 12 bytes of its digest. Insertions, lookups, deletions."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, state: bytes | None = None, arrays: list[np.ndarray] | None = None):
        if arrays is not None:
            self.n, self.size = (int(x) for x in arrays[0])
            self.cells = np.array(arrays[1])
        elif state is not None:
            self.n, self.size = struct.unpack("<QQ", state[:16])
            self.cells = np.frombuffer(state[16:], "<u2").copy()
        else:
            self.size, self.n = 1 << max(3, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.85))))), 0
            self.cells = np.zeros(self.size * self.SLOTS, "<u2")

    @staticmethod
    def parts(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "little"), int.from_bytes(key[8:10], "little") % 65535 + 1

    def places(self, key: bytes) -> tuple[int, int, int]:
        h, mark = self.parts(key)
        a = h & (self.size - 1)
        return a, self.other(a, mark), mark

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def insert(self, key: bytes) -> bool:
        """False if the filter is too full; it is then as before but for one displaced mark, so the caller rebuilds it."""
        a, b, mark = self.places(key)
        for bucket in (a, b):
            cell = self.cells[bucket * 4 : bucket * 4 + 4]
            if len(free := np.flatnonzero(cell == 0)):
                cell[free[0]] = mark
                self.n += 1
                return True
        bucket = b
        for kick in range(self.KICKS):
            at = bucket * 4 + kick % 4
            mark, self.cells[at] = int(self.cells[at]), mark
            bucket = self.other(bucket, mark)
            cell = self.cells[bucket * 4 : bucket * 4 + 4]
            if len(free := np.flatnonzero(cell == 0)):
                cell[free[0]] = mark
                self.n += 1
                return True
        return False

    def insert_many(self, keys: list[bytes]) -> bool:
        """Into an empty filter: four keys a bucket by sorting, the rest one by one."""
        if not keys:
            return True
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        first = np.ascontiguousarray(raw[:, :8]).view("<u8").ravel() & np.uint64(self.size - 1)
        marks = np.ascontiguousarray(raw[:, 8:10]).view("<u2").ravel() % 65535 + 1
        order = np.argsort(first, kind="stable")
        place = np.arange(len(order)) - np.searchsorted(first[order], first[order])
        fits = place < self.SLOTS
        self.cells[first[order][fits].astype(np.int64) * self.SLOTS + place[fits]] = marks[order][fits]
        self.n += int(fits.sum())
        return all(self.insert(keys[i]) for i in order[~fits].tolist())

    def delete(self, key: bytes) -> bool:
        a, b, mark = self.places(key)
        for bucket in (a, b):
            cell = self.cells[bucket * 4 : bucket * 4 + 4]
            if len(found := np.flatnonzero(cell == mark)):
                cell[found[0]] = 0
                self.n -= 1
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        a, b, mark = self.places(key)
        return mark in self.cells[a * 4 : a * 4 + 4] or mark in self.cells[b * 4 : b * 4 + 4]

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", self.n, self.size) + self.cells.tobytes()


def built(keys: list[bytes]) -> CuckooFilter:
    capacity = len(keys)
    while True:
        out = CuckooFilter(capacity)
        if out.insert_many(keys):
            return out
        capacity = capacity * 2 + 8


def line_keys(text: str) -> list[bytes]:
    """Digest of each line's key, b"" for a key shorter than MIN_CHARS."""
    out = []
    for line in text.encode().translate(_LOWER).split(b"\n"):
        key = line.strip(_BLANKS)
        out.append(hashlib.md5(key).digest() if key and (MIN_CHARS <= 1 or len(key.decode()) >= MIN_CHARS) else b"")
    return out


def reference_counts(docs: DataFrame) -> DataFrame:
    """(key, n_docs): documents that hold each key."""
    keys = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.translate(F.btrim(x, F.lit(_BLANKS.decode())), _UPPER_AZ, _LOWER_AZ))
    keys = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= MIN_CHARS))
    lines = docs.select(F.explode_outer(keys).alias("line")).where(F.col("line").isNotNull())
    return lines.select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))


def _shard(key: Column, shards: int) -> Column:
    return F.conv(F.hex(F.substring(key, 15, 2)), 16, 10).cast("int") % shards


class LineIndex:
    """The state: an exact table and filters, both in the shared folder. Each change writes a new version and removes the old."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.counts: DataFrame | None = None
        self.paths: list[str] = []
        self.shards = 0

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(reference_counts(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._change(reference_counts(docs).withColumn("n_docs", -F.col("n_docs")))

    def _change(self, delta: DataFrame) -> LineIndex:
        old, least = self.paths, self.min_docs
        self.paths = [new_path(self.spark, "lines"), new_path(self.spark, "filters")]
        if self.counts is None:
            rows = delta.select("key", F.lit(0).cast("long").alias("was"), F.col("n_docs").alias("now"))
        else:
            both = self.counts.select("key", F.col("n_docs").alias("was"), F.col("n_docs").alias("now")).unionByName(delta.select("key", F.lit(0).cast("long").alias("was"), F.col("n_docs").alias("now")))
            rows = both.groupBy("key").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
        state = table(rows.where((F.col("now") != 0) | (F.col("was") != 0)), "lines", self.paths[0])
        if not self.shards:
            heavy = state.where(F.col("now") >= least).count()
            self.shards = min(MOST_SHARDS, max(SHARDS, 1 << (heavy // SHARD_KEYS).bit_length()))
        crossing = state.where((F.col("was") >= least) != (F.col("now") >= least)).select("key", (F.col("now") >= least).alias("add"))
        full = self._update(crossing, old[1] if old else None, range(self.shards))
        if full:  # built anew from the exact table
            every = state.where((F.col("now") >= least) & _shard(F.col("key"), self.shards).isin(full)).select("key", F.lit(True).alias("add"))
            self._update(every, None, full)
        self.counts = state.where(F.col("now") != 0).select("key", F.col("now").alias("n_docs"))
        for p in old:
            remove(self.spark, p)
        return self

    def _update(self, keys: DataFrame, before: str | None, shards) -> list[int]:
        """Writes the filters of these shards, with the keys added or taken out; gives the shards whose filter ran full."""
        path = self.paths[1]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def close(shard: int, add: list[bytes], drop: list[bytes]) -> bool:
                have = built(add) if before is None else CuckooFilter(arrays=load(f"{before}/{shard}"))
                fits = before is None or all(have.insert(k) for k in add)
                for k in drop:
                    have.delete(k)
                save(f"{path}/{shard}", np.array([have.n, have.size], np.uint64), have.cells)
                return not fits

            full: list[int] = []
            at, lists = None, {True: [], False: []}
            for batch in batches:
                for shard, key, add in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "add"))):
                    if shard != at:
                        if at is not None and close(at, lists[True], lists[False]):
                            full.append(at)
                        at, lists = shard, {True: [], False: []}
                    if key is not None:
                        lists[add].append(key)
            if at is not None and close(at, lists[True], lists[False]):
                full.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32())], names=["shard"])

        every = self.spark.createDataFrame([(i, None, True) for i in shards], "shard int, key binary, add boolean")  # unchanged ones too
        rows = keys.select(_shard(F.col("key"), self.shards).alias("shard"), "key", "add").unionByName(every)
        n = min(self.shards, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return [r[0] for r in rows.repartition(n, "shard").sortWithinPartitions("shard", "key").mapInArrow(go, "shard int").collect()]

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with n_lines, n_dropped and kept (the text that stays); the other columns as they were."""
        heavy = self.counts.where(F.col("n_docs") >= self.min_docs)
        out, path, shards = _schema(docs), self.paths[1], self.shards
        if heavy.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            known = self.spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in heavy.select("key").toLocalIterator()))

            def go(batches):
                probe = Probe(path, shards)
                for batch in chunks(batches, limit=CHUNK_BYTES):
                    yield _dropped(batch, out.fieldNames(), [{i for i, k in enumerate(line_keys(t or "")) if k and k in probe and k in known.value} for t in batch.column("text").to_pylist()])

            return docs.mapInArrow(go, out)
        sizes = {r[0]: r[1] for r in heavy.groupBy(F.floor(F.log2("n_docs")).cast("int")).count().collect()}  # a row for each power of two
        least = next(p for p in range(65) if sum(n for q, n in sizes.items() if q >= p) <= BROADCAST_KEYS)
        common = self.spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in heavy.where(F.col("n_docs") >= F.lit(2.0**least)).select("key").toLocalIterator()))
        rare = heavy.where(F.col("n_docs") < F.lit(2.0**least)).select("key")
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.expr("uuid()").alias("rid"))
        own = table(own, "lines-rows")  # uuid() must be drawn once

        def passing(batches):
            probe = Probe(path, shards)
            for batch in chunks(batches, limit=CHUNK_BYTES):
                found = [(r, i, k) for r, t in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()) for i, k in enumerate(line_keys(t)) if k and k not in common.value and k in probe]
                yield pa.RecordBatch.from_pydict({"rid": [x[0] for x in found], "line": pa.array([x[1] for x in found], pa.int32()), "key": pa.array([x[2] for x in found], pa.binary())}, schema=pa.schema([("rid", pa.string()), ("line", pa.int32()), ("key", pa.binary())]))

        gone = own.select("rid", "text").mapInArrow(passing, "rid string, line int, key binary").join(rare, "key").groupBy("rid").agg(F.collect_list("line").alias("gone"))

        def go_joined(batches):
            for batch in batches:
                rows = pa.RecordBatch.from_struct_array(batch.column("row"))
                lost = [set(x or ()) | {i for i, k in enumerate(line_keys(t or "")) if k in common.value} for x, t in zip(batch.column("gone").to_pylist(), rows.column("text").to_pylist())]
                yield _dropped(rows, out.fieldNames(), lost)

        return own.join(gone, "rid", "left").select("row", "gone").mapInArrow(go_joined, out)


_PROBED: dict[str, tuple[int, memoryview]] = {}


class Probe:
    """The filters in their files, each mapped when it is first asked."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards, self.marks = path, shards, {}

    def _open(self, shard: int) -> tuple[int, memoryview]:
        uri = f"{self.path}/{shard}"
        if uri not in _PROBED:
            if len(_PROBED) > MOST_SHARDS:
                _PROBED.clear()
            head, cells = load(uri)
            _PROBED[uri] = int(head[1]), memoryview(cells)
        return _PROBED[uri]

    def __contains__(self, key: bytes) -> bool:
        shard = (key[14] << 8 | key[15]) % self.shards
        found = self.marks.get(shard)
        if found is None:
            found = self.marks[shard] = self._open(shard)
        size, cells = found
        mark = int.from_bytes(key[8:10], "little") % 65535 + 1
        a = int.from_bytes(key[:8], "little") & (size - 1)
        if mark in cells[a * 4 : a * 4 + 4]:
            return True
        b = (a ^ (mark * 0x5BD1E995)) & (size - 1)
        return mark in cells[b * 4 : b * 4 + 4]


_OUTPUTS = ("n_lines", "n_dropped", "kept")


def _schema(docs: DataFrame):
    """The input's columns and the outputs."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(free_names(docs.columns, _OUTPUTS), (LongType(), LongType(), StringType())))])


def _dropped(batch: pa.RecordBatch, out: list[str], gone: list[set[int]]) -> pa.RecordBatch:
    kept, n_lines, n_dropped = [], [], []
    for text, lost in zip(batch.column("text").to_pylist(), gone):
        text = text or ""
        n_lines.append(text.count("\n") + 1)
        n_dropped.append(len(lost))
        kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost) if lost else text)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=out)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    out = LineIndex(spark).insert(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') lk FROM l),
h AS (SELECT lk FROM k WHERE length(lk) >= 1 GROUP BY lk HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, h.lk IS NOT NULL gone FROM k LEFT JOIN h ON k.lk = h.lk)
SELECT any_value(doc_id) doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM m GROUP BY rid
"""
