"""Operator 1: substring dedup over prefix-partitioned suffix trees.

Suffixes begin at every word that LENGTH words follow. The tree of all suffixes of the corpus is cut into subtrees by prefixes of
variable length, chosen by content so that equal suffixes choose alike: the prefix of a suffix reaches to the end of the smallest
SEED-word hash among its first LENGTH words, so it has SEED to LENGTH words. Consecutive suffixes with one smallest seed travel
together, as one row with the fingerprints of their LENGTH-word paths; a suffix is read on from there fingerprint by fingerprint, a
word each.

1. Census: rows and suffixes of each seed are counted, with partial counts. A prefix that occurs once has no branching below it.
2. The rows under repeated seeds are dealt to tasks by seed. A seed with more than GROUP suffixes would not fit the memory set aside
   for a subtree: its prefixes are lengthened to the whole path and dealt by that. A path met twice within a chunk is a deep node
   already; the chunk resolves its own leaves and sends the node on once, so a passage in a third of all documents is a few rows
   per task.
3. A task sorts the suffixes of its subtrees (prefix doubling) and reads off the longest common prefixes of neighbours, which are
   the depths of the internal nodes. The deepest node above a suffix, if it is LENGTH words deep, gives a repeat that starts there;
   one inside the repeat of the suffix before is left out. Overlapping repeats of a document merge into its maximal ones.
4. Repeats meet their document again by the hash of its row.

The census goes to the tasks as a sorted array while it has at most BROADCAST_SEEDS repeated seeds; beyond that each document
gets the repeated seeds of its own rows by a join. Paths are 64-bit fingerprints compared within equal 64-bit seeds.

Defined cases: null or empty texts have no words; a document shorter than LENGTH words keeps all; repeated rows repeat each
other; a document may repeat itself, overlapping copies included; null doc_ids are ordinary; other columns stay untouched in
`clean`, and where one has an output's name, the output has "_" appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, chunks, drop, free_names, mix, ranges_hash, read_documents, release_early, table, text_buffer, trim

LENGTH = 35
SEED = 16
#: Suffixes of a subtree, of about 500 bytes each while it is sorted, and suffixes that a task sorts at once.
GROUP, FLUSH = 50_000, 100_000
BROADCAST_SEEDS = 4_000_000
CHUNK = 1 << 20


def _smaller(a, ca, b, cb):
    return np.minimum(a, b), np.where(a < b, ca, np.where(a > b, cb, np.minimum(ca.astype(np.int16) + cb, 99).astype(np.int8)))


def prefixes(words: Words) -> tuple[np.ndarray, ...]:
    """Rows of consecutive windows with one smallest seed: first window, number of windows, seed, whether the seed stands twice
    in the row; and the word hashes. One place of a seed is in at most `reach` windows, so a longer row has it twice, even if no
    window does (a text of period `reach`)."""
    n, reach = len(words), LENGTH - SEED + 1
    empty = np.zeros(0, np.int64)
    hashes = words.hashes()
    if n < LENGTH:
        return empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool), hashes
    at = np.arange(n - SEED + 1)
    low, count, width = ranges_hash(hashes, at, at + SEED), np.ones(len(at), np.int8), 1
    rest = None  # smallest over the odd parts of reach, taken from the right
    need, covered = reach, 0
    while True:
        if need & 1:
            part = low[covered:], count[covered:]
            if rest is None:
                rest = part
            else:
                m = min(len(rest[0]), len(part[0]))
                rest = _smaller(rest[0][:m], rest[1][:m], part[0][:m], part[1][:m])
            covered += width
        need >>= 1
        if not need:
            break
        low, count = _smaller(low[:-width], count[:-width], low[width:], count[width:])
        width *= 2
    windows = np.arange(n - LENGTH + 1)
    windows = windows[words.doc[windows] == words.doc[windows + LENGTH - 1]]
    if not len(windows):
        return empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool), hashes
    seed, twice = rest[0][windows], rest[1][windows] > 1
    first = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    many = np.diff(np.append(first, len(windows)))
    return windows[first], many, seed[first], np.logical_or.reduceat(twice, first) | (many > reach), hashes


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_early()
    for batch in chunks(batches, limit=CHUNK):
        _, many, seeds, twice, _ = prefixes(Words(*text_buffer(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(np.where(twice, 2, 1), pa.int64()), pa.array(many, pa.int64())], names=["seed", "n", "suffixes"])


def _seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=CHUNK):
        words = Words(*text_buffer(batch.column("text")))
        first, _, seeds, _, _ = prefixes(words)
        yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), batch.column("rid").take(pa.array(words.doc[first]))], names=["seed", "rid"])


def _known(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(seeds), bool)
    return keys[np.minimum(np.searchsorted(keys, seeds), len(keys) - 1)] == seeds


_ROWS = pa.schema([("part", pa.int64()), ("rid", pa.int64()), ("at", pa.int32()), ("upto", pa.int32()), ("paths", pa.binary())])


def _lists(paths: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Runs of paths, up to each end, or one by one, as a binary array (made from buffers: from memoryviews Arrow keeps them)."""
    bounds = np.append(0, np.arange(1, len(paths) + 1) if ends is None else ends).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(paths)])


def _suffixes(shared):
    """Rows (part, rid, at, upto, paths): windows from at on under one prefix; a null rid for a deep node; with null paths a span
    of words that is decided."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_early()
        for batch in chunks(batches, limit=CHUNK):
            words = Words(*text_buffer(batch.column("text")))
            first, many, seeds, _, hashes = prefixes(words)
            if shared is not None:
                repeated, hot = (_known(keys, seeds) for keys in shared.value)
            else:
                given = [(np.array(a or [], np.int64).view(np.uint64), np.array(b or [], np.int64).view(np.uint64)) for a, b in zip(batch.column("seeds").to_pylist(), batch.column("hot").to_pylist())]
                edges = np.searchsorted(words.doc[first], np.arange(batch.num_rows + 1))
                repeated, hot = (np.concatenate([np.isin(seeds[a:b], g[i]) for g, a, b in zip(given, edges, edges[1:])]) for i in (0, 1))
            rids = np.array(batch.column("rid").to_pylist(), np.int64)
            base = words.first[:-1]
            out: list[tuple] = []
            normal = np.flatnonzero(repeated & ~hot)
            if len(normal):
                total = many[normal]
                ends = np.cumsum(total)
                spots = np.repeat(first[normal] - (ends - total), total) + np.arange(ends[-1])
                docs = words.doc[first[normal]]
                out.append((seeds[normal].view(np.int64), rids[docs], first[normal] - base[docs], np.zeros(len(normal)), _lists(ranges_hash(hashes, spots, spots + LENGTH), ends)))
            large = np.flatnonzero(hot)
            if len(large):
                total = many[large]
                ends = np.cumsum(total)
                spots = np.repeat(first[large] - (ends - total), total) + np.arange(ends[-1])
                paths = ranges_hash(hashes, spots, spots + LENGTH)
                node, lead, inverse, counts = np.unique(paths, return_index=True, return_inverse=True, return_counts=True)
                docs = words.doc[spots]
                met = counts[inverse] > 1
                single = np.flatnonzero(~met)
                out.append((mix(paths[single]).view(np.int64), rids[docs[single]], spots[single] - base[docs[single]], np.zeros(len(single)), _lists(paths[single])))
                deep = node[counts > 1]
                out.append((mix(deep).view(np.int64), None, np.zeros(len(deep)), np.zeros(len(deep)), _lists(deep)))
                done = np.flatnonzero(met)
                if len(done):
                    edge = np.concatenate([[True], (spots[done][1:] != spots[done][:-1] + 1) | (docs[done][1:] != docs[done][:-1])])
                    a = done[edge]
                    b = done[np.append(np.flatnonzero(edge)[1:], len(done)) - 1]
                    out.append((rids[docs[a]], rids[docs[a]], spots[a] - base[docs[a]], spots[b] + LENGTH - base[docs[b]], None))
            for part, rid, at, upto, paths in out:
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(n, pa.int64()) if rid is None else pa.array(rid), pa.array(at.astype(np.int32)), pa.array(upto.astype(np.int32)), pa.nulls(n, pa.binary()) if paths is None else paths], schema=_ROWS)

    return go


def depths(paths: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each suffix paths[i : i + left[i]] the length of its longest common prefix with another one: the depth, in
    fingerprints, of the deepest internal node above it. Suffixes are ranked by their first 1, 2, 4, ... elements."""
    n = len(paths)
    here = np.arange(n)
    _, rank = np.unique(paths, return_inverse=True)
    ranks, width = [rank.astype(np.int32)], 1
    while width < left.max() and ranks[-1].max() + 1 < n:
        rank = ranks[-1].astype(np.int64)
        follow = np.where(left > width, rank[np.minimum(here + width, n - 1)] + 1, 0)
        ranks.append(np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n + 1, np.int64)  # of neighbours in suffix order, with none before the first and after the last
    for k, rank in reversed(list(enumerate(ranks))):
        a, b = order[:-1] + common[1:-1], order[1:] + common[1:-1]
        fits = (common[1:-1] + (1 << k) <= left[order[:-1]]) & (common[1:-1] + (1 << k) <= left[order[1:]])
        fits &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
        common[1:-1] += fits * (1 << k)
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


_SPANS = pa.schema([("rid", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _repeats(rows: pa.Table) -> pa.RecordBatch:
    """The repeats in whole subtrees: (rid, a, b), words [a, b) of a row."""
    rows = rows.combine_chunks()
    part, at = (np.asarray(rows.column(c)) for c in ("part", "at"))
    node = np.asarray(rows.column("rid").is_null())
    rid = np.asarray(rows.column("rid").fill_null(0))
    data = rows.column("paths").combine_chunks() if isinstance(rows.column("paths"), pa.ChunkedArray) else rows.column("paths")
    bounds = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    paths = np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.uint64)
    many = np.diff(bounds) // 8
    owner = np.repeat(np.arange(len(many)), many)
    ends = np.cumsum(many)
    step = np.arange(len(paths)) - (ends - many)[owner]
    depth = depths(paths ^ mix(part.view(np.uint64))[owner], ends[owner] - np.arange(len(paths)))
    inside = np.zeros(len(paths), bool)  # of the repeat of the suffix before
    inside[1:] = (owner[1:] == owner[:-1]) & (depth[:-1] > depth[1:])
    deep = np.flatnonzero((depth > 0) & ~node[owner] & ~inside)
    a = at[owner[deep]] + step[deep]
    return pa.RecordBatch.from_arrays([pa.array(rid[owner[deep]]), pa.array(a.astype(np.int32)), pa.array((a + depth[deep] + LENGTH - 1).astype(np.int32))], schema=_SPANS)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part to (rid, a, b): spans of repeated words. A flush holds whole parts."""
    release_early()
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        decided = batch.filter(batch.column("paths").is_null())
        if decided.num_rows:
            yield pa.RecordBatch.from_arrays([decided.column("rid"), decided.column("at"), decided.column("upto")], schema=_SPANS)
        batch = batch.filter(batch.column("paths").is_valid())
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("paths").nbytes // 8
        if size > FLUSH:
            rows = pa.Table.from_batches(held)
            part = np.asarray(rows.column("part"))
            cut = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if cut:
                yield _repeats(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.column("paths").nbytes // 8 for b in held)
            del rows
            trim()
    if held:
        yield _repeats(pa.Table.from_batches(held))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, spans): for each document with any, by the hash of its row, the spans [a, b) of words that occur elsewhere too."""
    spark = docs.sparkSession
    own = docs.select("text", F.xxhash64("doc_id", "text").alias("rid"))
    census = table(own.select("text").mapInArrow(_census, "seed long, n long, suffixes long").groupBy("seed").agg(F.sum("n").alias("n"), F.sum("suffixes").alias("suffixes")).where("n > 1"), "substring-census")
    if census.count() <= BROADCAST_SEEDS:
        found = census.withColumn("hot", F.col("suffixes") > GROUP).select("seed", "hot").toArrow().to_pandas()  # Arrow batches: 9 bytes a seed
        keys = [np.sort(found["seed"].to_numpy(np.int64)[mine].view(np.uint64)) for mine in (np.ones(len(found), bool), found["hot"].to_numpy(bool))]
        drop(census)
        rows = own.mapInArrow(_suffixes(spark.sparkContext.broadcast(tuple(keys))), "part long, rid long, at int, upto int, paths binary")
    else:
        mine = own.mapInArrow(_seeds_of, "seed long, rid long").join(census, "seed").groupBy("rid").agg(F.collect_set("seed").alias("seeds"), F.collect_set(F.when(F.col("suffixes") > GROUP, F.col("seed"))).alias("hot"))
        rows = own.join(mine, "rid").select("text", "rid", "seeds", "hot").mapInArrow(_suffixes(None), "part long, rid long, at int, upto int, paths binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_subtrees, "rid long, a int, b int")
    return spans.groupBy("rid").agg(F.array_distinct(F.collect_list(F.struct("a", "b"))).alias("spans"))


def removed(n_words: int, spans: list | None) -> np.ndarray | None:
    """Which words go, or None."""
    if not spans:
        return None
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, [s["a"] for s in spans], 1)
    np.add.at(edges, [s["b"] for s in spans], -1)
    return np.cumsum(edges[:-1]) > 0


def clean(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space); the other columns as they were."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), F.xxhash64("doc_id", "text").alias("rid"))
    out = StructType([StructField("row", own.schema["row"].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_early()
        for batch in chunks(batches, limit=CHUNK):
            kept, counts, gone = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode().split()
                out = removed(len(words), spans)
                counts.append(len(words))
                gone.append(0 if out is None else int(out.sum()))
                kept.append(b" ".join(words if out is None else compress(words, (~out).tolist())).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    met = own.join(repeated_spans(docs), "rid", "left").select("row", "text", "spans")
    wanted = ("n_words", "n_removed", "kept")
    return met.mapInArrow(go, out).select("row.*", *[F.col(c).alias(n) for c, n in zip(wanted, free_names(docs.columns, wanted))])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))




ORACLE_SQL = r"""
WITH w AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
p AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) k FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 33, 1))) i FROM w)),
r AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) j FROM p JOIN r USING (k)),
t AS (SELECT rid, unnest(ws) word, generate_subscripts(ws, 1) j FROM w)
SELECT any_value(w.doc_id) doc_id, any_value(len(ws))::BIGINT n_words, count(c.j) n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY t.j) FILTER (word IS NOT NULL AND c.j IS NULL), '')) kept_sha256
FROM w LEFT JOIN t USING (rid) LEFT JOIN c ON c.rid = t.rid AND c.j = t.j GROUP BY w.rid
"""
