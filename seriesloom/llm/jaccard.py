"""Operator 5: n-gram Jaccard self-join by chosen paths.

A document's set is that of its five-word shingles (a text of one to four words is one shingle). Documents with equal sets are
one node. Every node picks shared tokens by consistent sampling: at a tree node v it takes each of its shingles t with
h(v, t) < picks / |set|, so two sets of similarity 0.8 take a common shingle with probability 1 - exp(-0.8 picks) at least.
Each run draws a root of ROOT_PICKS picks; a bucket of at most SMALL sets is a leaf, a larger one is split by SPLIT_PICKS further
tokens, again and again up to DEPTH. A bucket whose sampled members share DENSE of their tokens on average is a leaf whatever its
size, since no token would part it. Large buckets with the same members go on as one, which is split by as many independent nodes
as it stands for (REPEATS at most, where all of them fail a pair with probability exp(-0.8 x 2 x 8) < 3e-6). Leaves are compared
exactly: intersections of the whole shingle sets, in numpy.

Recall. A pair at the threshold passes a split with probability 0.8 and any number of splits with 0.64, so RUNS runs of ROOT_PICKS
miss it with probability exp(-0.8 x 16) < 3e-6 where its buckets are leaves and exp(-0.8 x 16 x 0.64) < 3e-4 where all are large,
less for more similar pairs. It is measured too: the leaves say in how many runs each linked pair met,
and from the pairs met once and twice follows how many were never met (Chao's estimate). While the recall estimated so is below
RECALL, the join is repeated with twice the runs.

What keeps it bounded: buckets are counted before any set is shipped; buckets with the same members are compared once; a leaf of
more than CELL sets (or CELL_SHINGLES shingles) is dealt over a triangle of cells, and a cell returns one row per set (its number
of links and its component's root in the cell), never the pairs. A pair that meets in several leaves counts in the smallest leaf
they share. Exact link counts of n mutually similar texts need n^2 / 2 comparisons, made as matrix products; the rows sent for them
are n up to CELL and n^2 / CELL beyond. Before whole sets travel, a leaf sees sizes and samples of about SCREEN tokens: a set goes
on only if it has a partner there within the size ratio (exact) that shares at least SCREEN_SHARE of the smaller sample; a pair at
the threshold is expected to share 0.8 of 48 and falls below with probability under 1e-5. Links become classes by alternating star
contraction, each round written to the shared folder.

Defined cases: null texts and texts without words are linked to nothing and are their own class (class_id is their doc_id);
repeated rows are copies; null doc_ids take part, and a class of null doc_ids only has a null class_id; other columns are
ignored, and `one_of_each` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, chunks, drop, mix, ranges_hash, read_documents, table, text_buffer, trim

SHINGLE = 5
#: Similarity as a fraction, compared in integers.
NUMERATOR, DENOMINATOR = 4, 5
RUNS, ROOT_PICKS, SPLIT_PICKS, DEPTH = 4, 4, 2, 3
SMALL = 1024
#: Sets, and shingles, of a block; a cell compares two blocks, by matrix products of ROWS x COLUMNS.
CELL, CELL_SHINGLES, ROWS, COLUMNS = 2048, 4_000_000, 512, 2048
REPEATS = 8
#: A bucket is dense by the mean share of common tokens among about PROBE members.
DENSE, PROBE = 0.6, 16
SCREEN, SCREEN_SHARE = 48, 0.3
RECALL, MOST_RUNS = 0.999, 32
#: Rows whose 8-byte ids may be sent to every task to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
SCREEN_NODE = 1 << 40
_TOP = float(1 << 64)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their bounds."""
    hashes, out = words.hashes(), []
    starts = np.arange(max(0, len(words) - SHINGLE + 1))
    full = starts[words.doc[starts] == words.doc[starts + SHINGLE - 1]] if len(starts) else starts
    values = ranges_hash(hashes, full, full + SHINGLE)
    bounds = np.searchsorted(full, words.first)
    for i, n in enumerate(words.counts):
        if n >= SHINGLE:
            out.append(np.unique(values[bounds[i] : bounds[i + 1]]))
        else:
            at = words.first[i]
            out.append(ranges_hash(hashes, np.array([at]), np.array([at + n])) if n else values[:0])
    return np.concatenate(out) if out else values, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def set_keys(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)))]) for salt in (0x5E7A11, 0xC0FFEE0123)]
    a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    return [x.tobytes() + y.tobytes() if m else None for x, y, m in zip(a, b, np.diff(bounds))]


def picked(values: np.ndarray, bounds: np.ndarray, node: int, picks: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, bucket) of the tokens that each set takes at a node."""
    salt = mix(np.array([node], np.uint64))[0]
    drawn = mix(values ^ salt)
    sizes = np.diff(bounds)
    limit = np.repeat(picks / np.maximum(sizes, 1), sizes)
    spots = np.flatnonzero(drawn / _TOP < limit)
    return np.searchsorted(bounds, spots, "right") - 1, mix(drawn[spots] + salt).view(np.int64)


def _sketch(runs: int):
    """doc_id, rid, key of the set, its size, its roots' buckets (the run in the low bits), and its sample."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values, bounds = shingles(Words(*text_buffer(batch.column("text"))))
            found = [picked(values, bounds, r, ROOT_PICKS) for r in range(runs)]
            at = np.concatenate([x[0] for x in found])
            buckets = np.concatenate([x[1] & ~(MOST_RUNS - 1) | r for r, x in enumerate(found)])
            order = np.argsort(at, kind="stable")
            roots = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], np.arange(batch.num_rows + 1)), pa.int32()), pa.array(buckets[order]))
            who, tokens = picked(values, bounds, SCREEN_NODE, SCREEN)
            marks = (tokens.view(np.uint64) >> np.uint64(32)).astype("<u4")
            edges = np.searchsorted(who, np.arange(batch.num_rows + 1)).tolist()
            screen = pa.array([marks[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(set_keys(values, bounds), pa.binary()), pa.array(np.diff(bounds), pa.int64()), roots, screen], names=["doc_id", "rid", "key", "size", "roots", "screen"])

    return go


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        values, bounds = shingles(Words(*text_buffer(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, bounds), pa.binary()), pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["key", "shingles"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each set's large buckets. Of a bucket that stands for several, each child counts for one of their runs."""
    for batch in chunks(batches, "shingles"):
        keys, sizes, buckets, bits = [], [], [], []
        for key, data, paths in zip(*(batch.column(c).to_pylist() for c in ("key", "shingles", "paths"))):
            values = np.frombuffer(data, np.uint64)
            for p in paths:
                runs = [1 << r for r in range(MOST_RUNS) if p["runs"] >> r & 1]
                for repeat in range(min(p["stands"], REPEATS)):
                    node = (p["bucket"] + repeat * 0x9E3779B97F4A7C15) % (1 << 64)
                    found = picked(values, np.array([0, len(values)]), node, SPLIT_PICKS)[1]
                    keys += [key] * len(found)
                    sizes += [len(values)] * len(found)
                    bits += [runs[repeat % len(runs)]] * len(found)
                    buckets.append(found)
        columns = [pa.array(np.concatenate(buckets) if buckets else [], pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.ones(len(keys), np.int32)), pa.array(bits, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "size", "stands", "runs"])


def _shared(members: DataFrame) -> DataFrame:
    """(bucket, key, m, load, stands, runs): the members of buckets of two sets or more, one bucket of each membership; load is
    the sum of their sizes, stands the number of buckets (REPEATS at most) that it stands for, runs the bits of their runs."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("load"), F.bit_xor(F.xxhash64("key")).alias("sig"), F.max("stands").alias("stands"), F.bit_or("runs").alias("runs")).where("m > 1")
    once = sizes.groupBy("m", "load", "sig").agg(F.min("bucket").alias("bucket"), F.least(F.sum("stands"), F.lit(REPEATS)).cast("int").alias("stands"), F.bit_or("runs").alias("runs"))
    return members.select("bucket", "key").join(once.select("bucket", F.col("m").cast("int").alias("m"), "load", "stands", "runs"), "bucket")


def _mean_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets among these whose probed samples share DENSE of their tokens on average."""
    for batch in batches:
        out = []
        for bucket, screens in zip(batch.column("bucket").to_pylist(), batch.column("screens").to_pylist()):
            samples = [x for x in (np.frombuffer(s, "<u4") for s in screens) if len(x)]
            k = len(samples)
            if k > 1:
                taken = np.array([len(x) for x in samples])
                share = _overlap(samples, k) / np.minimum(taken[:, None], taken[None, :])
                if (share.sum() - np.trace(share)) / (k * (k - 1)) >= DENSE:
                    out.append(bucket)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["bucket"])


def _parted(members: DataFrame, sets: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """The members of leaves, and those of buckets that are still to be split."""
    if last:
        return members, members.limit(0)
    hot = members.where(F.col("m") > SMALL)
    probe = table(hot.where(F.pmod(F.xxhash64("key", "bucket"), F.ceil(F.col("m") / F.lit(PROBE))) == 0).select("bucket", "key"), "jaccard-probe")
    samples = (F.broadcast(probe) if probe.count() <= BROADCAST_IDS else probe).join(sets.select("key", "screen"), "key").groupBy("bucket").agg(F.collect_list("screen").alias("screens"))  # about PROBE each
    dense = table(samples.mapInArrow(_mean_share, "bucket long"), "jaccard-dense")
    sent = F.broadcast(dense) if dense.count() <= BROADCAST_IDS else dense
    return members.where(F.col("m") <= SMALL).unionByName(hot.join(sent, "bucket", "left_semi")), hot.join(sent, "bucket", "left_anti")


def _blocks(k: int) -> Iterator[slice]:
    return (slice(a, min(a + ROWS, k)) for a in range(0, k, ROWS))


def _overlap(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Sizes of the intersections, by incidence matrices over slices of the values that two sets share."""
    out = np.zeros((k, k), np.float32)
    every = np.concatenate(sets)
    if not len(every):
        return out
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    mine = counts[inverse] > 1
    column, owner = place[inverse[mine]], owner[mine]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(place[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        part = np.zeros((k, min(COLUMNS, int(place[-1]) + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        for rows in _blocks(k):
            out[rows] += part[rows] @ part.T
    return out


def _unmet(pairs: np.ndarray, leaves: list[list[int]], here: int) -> None:
    """Takes out of pairs those that meet in a leaf before this one."""
    met = _overlap([np.array([b for b in x if b < here], np.int64) for x in leaves], len(pairs))
    for rows in _blocks(len(pairs)):
        pairs[rows] &= met[rows] == 0


def _own_pairs(pairs: np.ndarray, side: np.ndarray | None) -> None:
    """Takes out the pairs of a set with itself and, off the diagonal, those within a block."""
    np.fill_diagonal(pairs, False)
    if side is not None:
        pairs &= side[:, None] != side[None, :]


def compare(sets: list[np.ndarray], copies: np.ndarray, leaves: list[list[int]], runs: list[list[int]], here: int, side: np.ndarray | None):
    """Links of each set in a cell (copies counted), its linked sets, how many of them it meets in one run only and in two, and the
    linked pairs' spanning forest. side: the blocks of a cell off the diagonal, whose pairs are of different blocks only."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets])
    both = _overlap(sets, k)
    linked = np.empty((k, k), bool)
    for rows in _blocks(k):
        common = both[rows].astype(np.float64)
        linked[rows] = DENOMINATOR * common >= NUMERATOR * (sizes[rows, None] + sizes[None, :] - common)
    del both
    _own_pairs(linked, side)
    if linked.any():
        _unmet(linked, leaves, here)
    links, pairs, once, twice = (np.zeros(k, np.int64) for _ in range(4))
    if linked.any():
        met = np.zeros((k, k), np.uint8)
        for r in range(MOST_RUNS):
            own = [np.array([b for b, m in zip(x, y) if m >> r & 1], np.int64) for x, y in zip(leaves, runs)]
            if any(map(len, own)):
                together = _overlap(own, k)
                for rows in _blocks(k):
                    met[rows] += together[rows] > 0
        for rows in _blocks(k):
            part = linked[rows]
            links[rows] = part.astype(np.float64) @ copies
            pairs[rows], once[rows], twice[rows] = part.sum(axis=1), (part & (met[rows] == 1)).sum(axis=1), (part & (met[rows] == 2)).sum(axis=1)
    return links, pairs, once, twice, forest(linked)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(set, root) of every set that is linked, roots being the smallest of a component."""
    k = len(linked)
    root = np.arange(k)
    while True:  # smallest label over neighbours, with jumps
        low = np.concatenate([np.where(linked[rows], root[None, :], k).min(axis=1, initial=k) for rows in _blocks(k)])
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(i, int(root[i])) for i in np.flatnonzero(linked.any(axis=1))]


def plausible(sizes: np.ndarray, samples: list[np.ndarray], leaves: list[list[int]], here: int, side: np.ndarray | None) -> np.ndarray:
    """Which sets of a cell have a partner that could be similar, and that they don't meet in an earlier leaf."""
    k = len(sizes)
    taken = np.array([len(x) for x in samples])
    both, pairs = _overlap(samples, k), np.empty((k, k), bool)
    for rows in _blocks(k):
        low, high = np.minimum(sizes[rows, None], sizes[None, :]), np.maximum(sizes[rows, None], sizes[None, :])
        pairs[rows] = (DENOMINATOR * low >= NUMERATOR * high) & (both[rows] >= SCREEN_SHARE * np.minimum(taken[rows, None], taken[None, :]))
    del both
    _own_pairs(pairs, side)
    if pairs.any():
        _unmet(pairs, leaves, here)
    return pairs.any(axis=1)


_CELL = ("cell", "bucket", "key", "m", "load", "leaves", "leaf_runs", "runs", "block", "across", "payload", "number")


def _by_cell(close, schema: pa.Schema):
    """A mapInArrow function over rows sorted by cell, which may run over several batches; close gives a cell's result rows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        found: list = []

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)
            found.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _CELL)):
                if rows and row[0] != rows[0][0]:
                    found.extend(close(sorted(rows, key=lambda r: r[2])) if len(rows) > 1 else ())
                    rows = []
                    if len(found) > 20_000:
                        yield out()
                rows.append(row)
            trim()
        if len(rows) > 1:
            found.extend(close(sorted(rows, key=lambda r: r[2])))
        rows.clear()
        yield out()
        trim()

    return go


def _close_screen(rows: list) -> list[tuple]:
    side = np.array([r[8] for r in rows]) if rows[0][9] else None
    stays = plausible(np.array([r[11] for r in rows]), [np.frombuffer(r[10], "<u4") for r in rows], [r[5] for r in rows], rows[0][1], side)
    return [(*rows[i][1:5], *rows[i][5:8]) for i in np.flatnonzero(stays)]


def _close_compare(rows: list) -> list[tuple]:
    side = np.array([r[8] for r in rows]) if rows[0][9] else None
    *counts, roots = compare([np.frombuffer(r[10], np.uint64) for r in rows], np.array([r[11] for r in rows]), [r[5] for r in rows], [r[6] for r in rows], rows[0][1], side)
    return [(rows[i][2], *(int(c[i]) for c in counts), rows[j][2]) for i, j in roots]


def _cells(leaves: DataFrame, facts: DataFrame, close, schema: pa.Schema) -> DataFrame:
    """Runs close over the cells of leaves (bucket, key, m, load, runs), with each set's facts (key, payload, number). A large leaf
    becomes a triangle of cells: each set goes to the cells of its block with every block; in a cell off the diagonal both blocks
    come with across = true, in one on it all rows are of its block."""
    own = F.collect_list(F.struct("bucket", "m", "load", "runs")).alias("at")
    if "leaves" in leaves.columns:  # screened: a set may have gone from leaves that it was in
        lists = leaves.groupBy("key").agg(own, F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("leaves", "leaf_runs")))).alias("every"))
        lists = lists.select("key", "at", F.transform("every", lambda x: x["leaves"]).alias("leaves"), F.transform("every", lambda x: x["leaf_runs"]).alias("leaf_runs"))
    else:
        lists = leaves.groupBy("key").agg(own).select("key", "at", F.transform("at", lambda x: x["bucket"]).alias("leaves"), F.transform("at", lambda x: x["runs"]).alias("leaf_runs"))
    spread = lists.join(facts, "key").select("key", "payload", "number", "leaves", "leaf_runs", F.explode("at").alias("at"))
    spread = spread.withColumn("g", F.greatest(F.ceil(F.col("at.m") / F.lit(CELL)), F.ceil(F.col("at.load") / F.lit(CELL_SHINGLES))).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("key"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cell = F.xxhash64("at.bucket", F.least("block", "other"), F.greatest("block", "other"))
    rows = spread.select(cell.alias("cell"), F.col("at.bucket").alias("bucket"), "key", F.col("at.m").alias("m"), F.col("at.load").alias("load"), "leaves", "leaf_runs", F.col("at.runs").alias("runs"), "block", (F.col("block") != F.col("other")).alias("across"), "payload", "number")
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_by_cell(close, schema), ", ".join(f"{f.name} {types[f.type]}" for f in schema))


_MEMBER = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("m", pa.int32()), ("load", pa.int64()), ("leaves", pa.list_(pa.int64())), ("leaf_runs", pa.list_(pa.int64())), ("runs", pa.int64())])
_LINKED = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("pairs", pa.int64()), ("once", pa.int64()), ("twice", pa.int64()), ("root", pa.binary())])


def _screened(leaves: DataFrame, sets: DataFrame) -> DataFrame:
    return table(_cells(leaves, sets.select("key", F.col("screen").alias("payload"), F.col("size").alias("number")), _close_screen, _MEMBER).distinct(), "jaccard-leaves")


def recall(linked: DataFrame, runs: int) -> float:
    """Chao's estimate from the linked pairs that met in one run only and in two."""
    n, once, twice = (x or 0 for x in linked.agg(F.sum("pairs") / 2, F.sum("once") / 2, F.sum("twice") / 2).first())
    missed = (runs - 1) / runs * (once * once / (2 * twice) if twice else once * (once - 1) / 2)
    if runs == 1:
        missed = n  # nothing to compare a single run with
    return n / (n + missed) if n else 1.0


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each component, for keys with an edge. Edges are (a, b) with a > b. Each round at least
    halves the long paths, so a handful suffices; it ends when a round changes nothing."""
    at, before = table(edges.distinct(), "edges"), None
    while True:
        state = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.when(F.col("m") < F.col("a"), F.col("m")).otherwise(F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        last, at = at, table(small.select("a", F.col("m").alias("b")).unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        drop(last)
    return at.select(F.col("a").alias("key"), F.col("b").alias("label"))


def _with_rid(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("rid"))


def join(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """One row per input row: doc_id, rid, key (of its set), label (of its class), n_links, n_copies."""
    runs = runs or RUNS
    rows, sets, linked = _links(_with_rid(docs), runs)
    while recall(linked, runs) < RECALL:
        if 2 * runs > MOST_RUNS:
            raise RuntimeError(f"{runs} runs have not reached a recall of {RECALL}")
        drop(rows, sets, linked)
        runs *= 2
        rows, sets, linked = _links(_with_rid(docs), runs)
    labels = components(linked.where(F.col("key") > F.col("root")).select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    facts = sets.select("key", "copies").join(counts, "key", "left").join(labels, "key", "left")
    facts = facts.select("key", F.coalesce("label", "key").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    return rows.select("doc_id", "rid", "key").join(facts, "key", "left")


def _links(own: DataFrame, runs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sets' keys, the distinct sets, and the linked sets with their counts and roots; all written."""
    rows = table(own.mapInArrow(_sketch(runs), "doc_id long, rid long, key binary, size long, roots array<long>, screen binary"), "jaccard-rows")
    sets = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("roots").alias("roots"), F.first("screen").alias("screen"))
    sets = table(sets, "jaccard-sets")
    roots = sets.select("key", "size", F.explode("roots").alias("bucket")).select("bucket", "key", "size", F.lit(1).alias("stands"), F.expr(f"shiftleft(1L, CAST(bucket & {MOST_RUNS - 1} AS INT))").alias("runs"))
    members = table(_shared(roots), "jaccard-members")
    parts, hot = _parted(members, sets, False)
    leaves = _screened(parts, sets)
    work = [members, leaves]
    met = leaves.select("key").unionByName(hot.select("key")).distinct()
    near = table(sets.join(met, "key", "left_semi").select("key", "rep", "copies", "size", "screen"), "jaccard-near")
    repeated = bool(rows.groupBy("rid").count().where("count > 1").limit(1).count())

    def shingles_of(keys: DataFrame) -> DataFrame:
        """(key, shingles) of these sets, from the text of one document each."""
        reps = near.join(keys.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("rid"))
        held = own.join(F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps, "rid", "left_semi").select("text").mapInArrow(_sets, "key binary, shingles binary")
        return held.groupBy("key").agg(F.first("shingles").alias("shingles")) if repeated else held

    held = None
    for depth in range(1, DEPTH + 1):
        if not hot.limit(1).count():
            break
        if held is None:  # children's members are members of their parents
            held = table(shingles_of(hot), "jaccard-shingles")
            work.append(held)
        grown = hot.groupBy("key").agg(F.collect_list(F.struct("bucket", "stands", "runs")).alias("paths")).join(held, "key")
        split = grown.select("key", "shingles", "paths").mapInArrow(_split, "bucket long, key binary, size long, stands int, runs long")
        members = table(_shared(split), "jaccard-members")
        parts, hot = _parted(members, near, depth == DEPTH)
        done = _screened(parts, near)
        work += [members, done]
        leaves = leaves.unionByName(done.select(*leaves.columns))
    facts = shingles_of(leaves).join(near.select("key", F.col("copies").alias("number")), "key").withColumnRenamed("shingles", "payload")
    linked = table(_cells(leaves, facts, _close_compare, _LINKED), "jaccard-links")
    drop(*work, near)  # what follows reads rows, sets, links and labels
    return rows, sets, linked


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_links, n_copies."""
    found = join(docs)
    named = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return found.join(named, "label", "left").select("doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those near-duplicate to one of a smaller (doc_id, row hash) in their class; every column as it was."""
    found = table(join(docs), "jaccard-found")
    first = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct(F.col("doc_id"), F.col("rid"))).alias("first")).select(F.col("first.rid").alias("rid"))
    stay = first.unionByName(found.where(F.col("label").isNull()).select("rid")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("rid"))
    kept = own.join(stay, "rid", "left_semi")
    if found.where(F.col("label").isNotNull()).groupBy("rid").count().where("count > 1").limit(1).count():
        words = F.regexp_count("row.text", F.lit(r"[^\x20\x09-\x0D]+"))
        kept = kept.where(F.coalesce(words, F.lit(0)) > 0).groupBy("rid").agg(F.first("row").alias("row")).select("rid", "row").unionByName(kept.where(F.coalesce(words, F.lit(0)) == 0).select("rid", "row"))
    return kept.select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') k FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) n FROM s GROUP BY rid),
o AS (SELECT a.rid x, b.rid y, count(*) c FROM s a JOIN s b ON a.k = b.k AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y, c = p.n AND c = q.n same FROM o JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach AS (SELECT rid x, rid y FROM w UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
m AS (SELECT reach.x rid, min(w.doc_id) class_id FROM reach JOIN w ON w.rid = reach.y GROUP BY reach.x),
k AS (SELECT x rid, count(*) n_links, count(*) FILTER (same) n_copies FROM l GROUP BY x)
SELECT w.doc_id, class_id, coalesce(n_links, 0) n_links, coalesce(n_copies, 0) n_copies FROM w JOIN m USING (rid) LEFT JOIN k USING (rid)
"""
