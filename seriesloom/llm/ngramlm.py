"""Operator 6: interpolated modified Kneser-Ney trigram model, counted in Spark, memory-mapped by the workers.

Words. Tasks send distinct word hashes with counts; a bucket of hashes becomes a file, sorted by hash. A word's id is its rank by
count in the bucket times the number of buckets plus the bucket, so frequent words have small ids. Counting trigrams and scoring look
words up in the mapped files.

Trigrams. Tasks reduce their texts to distinct trigrams (u, v, w) with counts and send one row per (flush, bucket): ids in byte planes,
compressed. Buckets are dealt by the middle word v. So one shuffle brings together all of a context (u, v) with its followers, all
left neighbours of a pair (v, w), and all pairs of v: whatever the model needs but for two sums. Middle words with more than 1 / (2
buckets) of all tokens, 2 x buckets of them at most, are spread by (v, u), which keeps their contexts whole; their pairs' left
neighbours are added up in a second, small shuffle. The numbers of words before each word are the other. The number of buckets is
SPREAD x spark.sql.shuffle.partitions, so a group's size is set by the cluster's configuration; the small shuffles go to fewer parts
while a bucket has too little for each.

Storage. A bucket's trigrams, contexts and pairs are sorted hash arrays in files of the shared folder: 48 bits of the hash, which
in a bucket of n entries mistakes an absent one for a present one with probability n / 2^48; entries counted once as keys alone, the
others with their counts, which are exact however large. Workers map the files into memory and search them with each chunk's sorted
keys; pages are shared by all workers of a machine. Where the folder is not a mounted file system a worker fetches a file once.

    p(w|u,v) = (c(uvw) - D3) / c(uv) + gamma(uv) p(w|v),   p(w|v) = (N1+(.vw) - D2) / N1+(.v.) + gamma(v) p(w),
    p(w) = (N1+(.w) - D1) / N1+(..) + gamma / (V + 1)

with modified discounts for counts 1, 2 and 3 or more from the counts of counts of each order. Two marks precede a text; they have no
left neighbours, so its first word's p(w|u,v) is interpolated with p(w). An unseen context leaves the lower order.

Defined cases: a null or empty text is the end token alone (scored, and a training text if not held out); without training text
every probability is 1 / (V + 1) = 1; repeated rows count and are scored each; a null doc_id hashes as the empty text; other
columns are ignored. Words are told apart by 64-bit hashes: two of n share one with probability n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, chunks, crc_mod, drop, load, mix, new_path, read_documents, release_early, save, table, trim, words_of

END = np.uint64(0xE4D0000000000001)
HELD = 1_000_000
SPREAD = 2
#: Tokens for each row that goes from a bucket of trigrams to one of words or hot pairs.
ROW_PAIRS = 2000
#: Ids from which 32 bits are not enough.
WIDE = (1 << 32) - 2
SCORE_CHUNK = 6 << 20
#: Statistics of an entry that is stored as a key alone.
SINGLE = {"tri": (1,), "ctx": (1, 1, 0, 0), "pair": (1,), "hot": (1,)}
_U64 = np.dtype("<u8")
_MAPPED: dict[str, list[np.ndarray]] = {}


# ------------------------------------------------------------------------------------------------------- storage
def small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; the places and values of those from 255 on."""
    large = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), large.astype(_U64), counts[large].astype(_U64)]


def value(stored: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = stored[0][at].astype(np.float64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = stored[2][np.searchsorted(stored[1], at[large].astype(_U64))]
    return out


def save_table(uri: str, kind: str, hashes: np.ndarray, *stats: np.ndarray) -> None:
    keys = hashes >> np.uint64(16)
    order = np.argsort(keys, kind="stable")
    keys, stats = keys[order], [s[order] for s in stats]
    alone = np.logical_and.reduce([s == x for s, x in zip(stats, SINGLE[kind])]) if len(keys) else np.zeros(0, bool)
    halves = [x for k in (keys[alone], keys[~alone]) for x in ((k >> np.uint64(16)).astype("<u4"), k.astype("<u2"))]
    save(uri, *halves, *(x for s in stats for x in small(s[~alone])))


def _place(high: np.ndarray, low: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands, and which do."""
    a, b = (keys >> np.uint64(16)).astype(np.uint32), keys.astype(np.uint16)
    at = np.searchsorted(high, a)
    hit = np.zeros(len(keys), bool)
    left = np.flatnonzero(at < len(high))
    while len(left):
        same = high[at[left]] == a[left]
        found = same & (low[at[left]] == b[left])
        hit[left[found]] = True
        left = left[same & ~found]
        at[left] += 1
        left = left[at[left] < len(high)]
    return at, hit


def mapped(uri: str) -> list[np.ndarray]:
    if uri not in _MAPPED:
        if len(_MAPPED) > 8192:
            _MAPPED.clear()
        _MAPPED[uri] = load(uri)
    return _MAPPED[uri]


# ------------------------------------------------------------------------------------------------------ counting
def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(_U64) + np.uint64(0xBE61)) + b.astype(_U64) * np.uint64(0x9E3779B97F4A7C15))


def token_stream(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all documents in order (words, then the end), and the first token of each document."""
    n = len(words.counts)
    tokens = np.empty(len(words) + n, np.uint64)
    tokens[np.arange(len(words)) + words.doc] = words.hashes(LOWER)
    tokens[words.first[1:] + np.arange(n)] = END
    return tokens, words.first[:-1] + np.arange(n)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _starts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(np.append(True, new))


def _order(*columns: np.ndarray) -> np.ndarray:
    """Sorted order of rows, the first column first; two columns of 32 bits are compared as one."""
    keys: list[np.ndarray] = []
    i = 0
    while i < len(columns):
        if i + 1 < len(columns) and columns[i].dtype.itemsize <= 4 and columns[i + 1].dtype.itemsize == 4:
            keys.append(columns[i].astype(_U64) << np.uint64(32) | columns[i + 1])
            i += 2
        else:
            keys.append(columns[i])
            i += 1
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in byte planes, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], _U64).tobytes()
    return head + pa.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays), "zstd", asbytes=True)


def expand(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, _U64, 1)[0])
    facts = np.frombuffer(data, _U64, 2 * n, 8).astype(np.int64).reshape(n, 2)
    raw = pa.decompress(data[8 + 16 * n :], int(facts.prod(axis=1).sum()), "zstd", asbytes=True)
    out, at = [], 0
    for size, length in facts.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length).T).view(f"<u{size}").ravel())
        at += size * length
    return out


_ROW = "kind int, bucket int, data binary"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
WORDS, TRIGRAMS, BEFORE, HOT, TRI_COUNTS, PAIR_COUNTS, WORD_COUNTS, OPENING, HOT_STATS, SIZES = range(10)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW.types)], schema=_ARROW)


def _dealt(kind: int, buckets: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One row per bucket of arrays that are sorted by bucket."""
    first = _starts(buckets)
    return [(kind, int(buckets[a]), squeeze(*(x[a:b] for x in arrays))) for a, b in zip(first, np.append(first[1:], len(buckets)))]


def _unigrams(buckets: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_early()
        held: list = []

        def merged():
            return summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

        for batch in chunks(batches):
            keys, n = np.unique(token_stream(words_of(batch))[0], return_counts=True)
            held.append((keys, n.astype(_U64)))
            if sum(len(x[0]) for x in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield _rows(_dealt(WORDS, bucket_of(held[0][0], buckets), *held[0]))
                    held = []
        if held:
            keys, n = merged()
            yield _rows(_dealt(WORDS, bucket_of(keys, buckets), keys, n))

    return go


def _merge_words(path: str):
    """The words of a bucket to their file: hashes, ranks by count, counts."""

    def go(group: pa.Table) -> pa.Table:
        release_early()
        bucket = group.column("bucket")[0].as_py()
        parts = [expand(x.as_py()) for x in group.column("data")]
        keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        rank = np.empty(len(keys), np.uint32)
        rank[np.lexsort((keys, -counts.astype(np.int64)))] = np.arange(len(keys), dtype=np.uint32)
        save(f"{path}/word-{bucket}", keys, rank, *small(counts))
        return pa.Table.from_batches([_rows([(SIZES, bucket, squeeze(np.array([len(keys), counts.sum()], _U64)))])])

    return go


class Vocabulary:
    """Ids and counts of words, from the mapped files. wide: ids of 64 bits, where 32 are not enough."""

    def __init__(self, path: str, buckets: int, have: set[int], wide: bool):
        self.path, self.buckets, self.have, self.type = path, buckets, have, np.uint64 if wide else np.uint32
        self.begin, self.unknown = self.type(np.iinfo(self.type).max), self.type(np.iinfo(self.type).max - 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct, sorted hashes: ids (unknown where absent) and counts."""
        ids, counts = np.full(len(hashes), self.unknown), np.zeros(len(hashes))
        edges = np.searchsorted(bucket_of(hashes, self.buckets), np.arange(self.buckets + 1)).tolist()
        for b, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high and b in self.have:
                keys, rank, *n = mapped(f"{self.path}/word-{b}")
                at = np.minimum(np.searchsorted(keys, hashes[low:high]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == hashes[low:high])
                ids[low + hit] = rank[at[hit]].astype(self.type) * self.type(self.buckets) + self.type(b)
                counts[low + hit] = value(n, at[hit])
        return ids, counts

    def distinct(self, words) -> tuple[np.ndarray, ...]:
        """Ids and counts of the distinct tokens, of every token its place among them, and the first token of each document."""
        tokens, firsts = token_stream(words)
        known, inverse = np.unique(tokens, return_inverse=True)
        return *self.find(known), inverse, firsts

    def triples(self, w: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """u, v, w of every token."""
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[firsts] = self.begin
        u = np.empty_like(w)
        u[1:] = v[:-1]
        u[firsts] = self.begin
        return u, v, w

    def spots(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Buckets of trigrams: by v; by (v, u) for a hot v; the opening of a text by its word."""
        out = bucket_of(mix(v.astype(_U64)), self.buckets)
        mine = np.flatnonzero(np.isin(v, hot))
        out[mine] = bucket_of(mix(hashed(v[mine], u[mine])), self.buckets)
        mine = np.flatnonzero(v == self.begin)
        out[mine] = bucket_of(mix(hashed(v[mine], w[mine])), self.buckets)
        return out


def _hot_words(vocabulary: Vocabulary, least: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("bucket").to_pylist():
                keys, rank, *n = mapped(f"{vocabulary.path}/word-{b}")
                mine = np.flatnonzero(value(n, np.arange(len(keys))) > least)
                ids = rank[mine].astype(np.uint64) * np.uint64(vocabulary.buckets) + np.uint64(b)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64))], names=["id"])

    return go


def _trigrams(vocabulary: Vocabulary, hot: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_early()
        held: list = []

        def flush():
            u, v, w = (np.concatenate([x[i] for x in held]) for i in range(3))
            spot = vocabulary.spots(u, v, w, hot).astype(np.uint32)
            order = _order(spot, v, u, w)
            u, v, w, spot = u[order], v[order], w[order], spot[order]
            first = _starts(v, u, w, spot)
            n = np.diff(np.append(first, len(u)))
            u, v, w, spot = u[first], v[first], w[first], spot[first]
            rows, edges = [], _starts(spot)
            for a, b in zip(edges, np.append(edges[1:], len(u))):
                run = _starts(v[a:b])
                more = np.flatnonzero(n[a:b] > 1)
                rows.append((TRIGRAMS, int(spot[a]), squeeze(v[a:b][run], np.diff(np.append(run, b - a)).astype(np.uint32), u[a:b], w[a:b], more.astype(np.uint32), n[a:b][more].astype(np.uint32))))
            return _rows(rows)

        for batch in chunks(batches):
            ids, _, inverse, firsts = vocabulary.distinct(words_of(batch))
            held.append(vocabulary.triples(ids[inverse], firsts))
            if sum(len(x[0]) for x in held) > HELD:
                yield flush()
                held = []
                trim()
        if held:
            yield flush()

    return go


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:6].astype(_U64)


def _stats(first: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Of each run: total, and numbers of entries counted once, twice, oftener."""
    return [np.add.reduceat(x.astype(_U64), first) if len(first) else np.zeros(0, _U64) for x in (c, c == 1, c == 2, c > 2)]


def _merge_trigrams(vocabulary: Vocabulary, hot: np.ndarray, parts: int):
    path = vocabulary.path

    def go(group: pa.Table) -> pa.Table:
        release_early()
        bucket = group.column("bucket")[0].as_py()
        us, vs, ws, ns = [], [], [], []
        for x in group.column("data"):
            run, length, u, w, more, n = expand(x.as_py())
            count = np.ones(len(u), np.uint64)
            count[more] = n
            us.append(u), vs.append(np.repeat(run, length)), ws.append(w), ns.append(count)
        u, v, w, n = (np.concatenate(x) for x in (us, vs, ws, ns))
        del us, vs, ws, ns
        order = _order(v, u, w)
        u, v, w, n = u[order], v[order], w[order], n[order]
        first = _starts(v, u, w)
        u, v, w, n = u[first], v[first], w[first], np.add.reduceat(n, first)
        save_table(f"{path}/tri-{bucket}", "tri", hashed(hashed(u, v), w), n)
        rows = [(TRI_COUNTS, bucket, squeeze(_counts_of_counts(n)))]
        context = _starts(v, u)
        stats = _stats(context, n)
        opening = v[context] == vocabulary.begin
        if opening.any():
            rows.append((OPENING, bucket, squeeze(*(s[opening] for s in stats))))
        context, stats = context[~opening], [s[~opening] for s in stats]
        save_table(f"{path}/ctx-{bucket}", "ctx", hashed(u[context], v[context]), *stats)
        del u, n, stats
        order = _order(v, w)
        v, w = v[order], w[order]
        first = _starts(v, w)
        left = np.diff(np.append(first, len(v))).astype(_U64)
        v, w = v[first], w[first]
        shared = np.isin(v, hot)
        if shared.any():
            spot = bucket_of(mix(hashed(v[shared], w[shared])), parts)
            order = np.argsort(spot, kind="stable")
            rows += _dealt(HOT, spot[order], *(x[shared][order] for x in (v, w, left)))
        v, w, left = v[~shared], w[~shared], left[~shared]
        rows += _before(w, vocabulary.buckets, parts)
        inner = v != vocabulary.begin
        v, w, left = v[inner], w[inner], left[inner]
        rows.append((PAIR_COUNTS, bucket, squeeze(_counts_of_counts(left))))
        save_table(f"{path}/pair-{bucket}", "pair", hashed(v, w), left)
        run = _starts(v)
        save(f"{path}/one-{bucket}", v[run], *_stats(run, left))
        return pa.Table.from_batches([_rows(rows)])

    return go


def _before(w: np.ndarray, buckets: int, parts: int) -> list[tuple[int, int, bytes]]:
    """Rows of how many pairs end in each word, by the words' buckets modulo parts."""
    ids, n = np.unique(w, return_counts=True)
    spot = (ids % ids.dtype.type(buckets)).astype(np.int64) % parts
    order = np.argsort(spot, kind="stable")
    return _dealt(BEFORE, spot[order], ids[order], n[order].astype(_U64))


def _merge_hot(vocabulary: Vocabulary, parts: int):
    """The pairs of hot middle words: left neighbours added up over the buckets of (v, u)."""

    def go(group: pa.Table) -> pa.Table:
        release_early()
        bucket = group.column("bucket")[0].as_py()
        v, w, left = (np.concatenate(x) for x in zip(*(expand(x.as_py()) for x in group.column("data"))))
        order = _order(v, w)
        v, w, left = v[order], w[order], left[order]
        first = _starts(v, w)
        v, w, left = v[first], w[first], np.add.reduceat(left, first)
        save_table(f"{vocabulary.path}/hot-{bucket}", "hot", hashed(v, w), left)
        run = _starts(v)
        rows = [(PAIR_COUNTS, bucket, squeeze(_counts_of_counts(left))), (HOT_STATS, bucket, squeeze(v[run].astype(_U64), *_stats(run, left)))]
        return pa.Table.from_batches([_rows(rows + _before(w, vocabulary.buckets, parts))])

    return go


def _hot_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in expand(data)], names=["v", "s0", "s1", "s2", "s3"])


def _merge_before(vocabulary: Vocabulary):
    """The numbers of words before each word, by rank, of the buckets that come together."""

    def go(group: pa.Table) -> pa.Table:
        release_early()
        ids, n = (np.concatenate(x) for x in zip(*(expand(x.as_py()) for x in group.column("data"))))
        buckets, rows = ids.dtype.type(vocabulary.buckets), []
        spot = (ids % buckets).astype(np.int64)
        for bucket in np.unique(spot).tolist():
            seen = np.zeros(len(mapped(f"{vocabulary.path}/word-{bucket}")[0]), _U64)
            mine = spot == bucket
            np.add.at(seen, (ids[mine] // buckets).astype(np.int64), n[mine])
            save(f"{vocabulary.path}/seen-{bucket}", *small(seen))
            rows.append((WORD_COUNTS, bucket, squeeze(np.append(_counts_of_counts(seen[seen > 0]), seen.sum()).astype(_U64))))
        return pa.Table.from_batches([_rows(rows)])

    return go


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of items counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


class Model:
    """What the driver knows of a model: sizes, discounts, the hot words with their statistics; workers map the files."""

    def __init__(self, vocabulary: Vocabulary, have: dict[str, set[int]], n_tokens: int, n_words: int, hot: np.ndarray, hot_stats: list[np.ndarray], opening: np.ndarray, d: list[np.ndarray], total: float, spread: float, parts: int):
        self.vocabulary, self.have, self.n_tokens, self.n_words, self.hot, self.hot_stats, self.opening, self.d, self.total, self.spread, self.parts = vocabulary, have, n_tokens, n_words, hot, hot_stats, opening, d, total, spread, parts

    def _stored(self, kind: str, hashes: np.ndarray, spots: np.ndarray) -> list[np.ndarray]:
        """The statistics of each hash (0 where absent), in the buckets given."""
        out = [np.zeros(len(hashes)) for _ in SINGLE[kind]]
        keys = hashes >> np.uint64(16)
        if self.vocabulary.buckets <= 1 << 16:  # the key and its bucket in one word
            order = np.argsort(keys | spots.astype(np.uint64) << np.uint64(48))
        else:
            order = np.lexsort((keys, spots))
        edges = np.searchsorted(spots[order], np.arange(self.vocabulary.buckets + 1)).tolist()
        for b, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high and b in self.have[kind]:
                mine = order[low:high]
                files = mapped(f"{self.vocabulary.path}/{kind}-{b}")
                _, hit = _place(files[0], files[1], keys[mine])
                for o, x in zip(out, SINGLE[kind]):
                    o[mine[hit]] = x
                mine = mine[~hit]
                at, hit = _place(files[2], files[3], keys[mine])
                for i, o in enumerate(out):
                    o[mine[hit]] = value(files[4 + 3 * i : 7 + 3 * i], at[hit])
        return out

    def _before(self, w: np.ndarray) -> np.ndarray:
        """N1+(.w) of distinct words."""
        out, buckets = np.zeros(len(w)), self.vocabulary.type(self.vocabulary.buckets)
        known = np.flatnonzero(w < self.vocabulary.unknown)
        spots = (w[known] % buckets).astype(np.int64)
        for b in np.unique(spots).tolist():
            if b in self.have["seen"]:
                mine = known[spots == b]
                out[mine] = value(mapped(f"{self.vocabulary.path}/seen-{b}"), (w[mine] // buckets).astype(np.int64))
        return out

    def _middle(self, v: np.ndarray) -> list[np.ndarray]:
        """N1+(.v.) and the numbers of pairs (v, w) with one, two and more left neighbours, of distinct words."""
        out = [np.zeros(len(v)) for _ in range(4)]
        spots = bucket_of(mix(v.astype(_U64)), self.vocabulary.buckets)
        for b in np.unique(spots).tolist():
            if b in self.have["one"]:
                words, *stats = mapped(f"{self.vocabulary.path}/one-{b}")
                mine = np.flatnonzero(spots == b)
                at = np.searchsorted(words, v[mine])
                hit = at < len(words)
                hit[hit] = words[at[hit]] == v[mine[hit]]
                for o, s in zip(out, stats):
                    o[mine[hit]] = s[at[hit]]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            hit = self.hot[at] == v
            for o, s in zip(out, self.hot_stats):
                o[hit] = s[at[hit]]
        return out

    def tokens(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability and count of every token, and the first token of each document."""
        ids, counts, inverse, firsts = self.vocabulary.distinct(words)
        u, v, w = self.vocabulary.triples(ids[inverse], firsts)
        d3, d2, d1 = self.d
        used = lambda x, d: np.maximum(x - d[np.minimum(x, 3).astype(np.int64)], 0)
        p = (used(self._before(ids), d1) / max(self.total, 1) + self.spread / (self.n_words + 1))[inverse]
        total, *rest = (np.append(0, x[inverse][:-1]) for x in self._middle(ids))
        for x in (total, *rest):  # nothing stands before a text
            x[firsts] = 0
        is_hot, n = np.isin(v, self.hot), np.zeros(len(v))
        plain, mine, h = np.flatnonzero(~is_hot), np.flatnonzero(is_hot), hashed(v, w)
        n[plain] = self._stored("pair", h[plain], bucket_of(mix(v[plain].astype(_U64)), self.vocabulary.buckets))[0]
        n[mine] = self._stored("hot", h[mine], bucket_of(mix(h[mine]), self.parts))[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            higher = used(n, d2) / total + sum(x * y for x, y in zip(d2[1:], rest)) / total * p
            p = np.where(total > 0, higher, p)

        h, spots = hashed(u, v), self.vocabulary.spots(u, v, w, self.hot)
        total, *rest = self._stored("ctx", h, spots)
        start = v == self.vocabulary.begin
        for x, y in zip((total, *rest), self.opening):
            x[start] = y
        n = self._stored("tri", hashed(h, w), spots)[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            higher = used(n, d3) / total + sum(x * y for x, y in zip(d3[1:], rest)) / total * p
            return np.where(total > 0, higher, p), counts[inverse], firsts

    def score(self, words) -> dict[str, np.ndarray]:
        p, c, firsts = self.tokens(words)
        base = np.log10((c + 1) / (self.n_tokens + self.n_words + 1))
        return {"n_tokens": words.counts + 1, "n_known": np.add.reduceat((c > 0).astype(np.int64), firsts), "base_score": np.add.reduceat(base, firsts), "score": np.add.reduceat(np.log10(p), firsts)}


def fit(docs: DataFrame) -> Model:
    """The model of all texts of docs."""
    spark = docs.sparkSession
    texts = docs.select("text")
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "lm")
    found = texts.mapInArrow(_unigrams(buckets), _ROW).groupBy("bucket").applyInArrow(_merge_words(path), _ROW).collect()  # a row for each bucket
    sizes = {r["bucket"]: [int(x) for x in expand(bytes(r["data"]))[0]] for r in found}
    n_words, n_tokens = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    vocabulary = Vocabulary(path, buckets, set(sizes), max((x[0] for x in sizes.values()), default=0) * buckets >= WIDE)
    each = spark.createDataFrame([(b,) for b in sizes], "bucket int").repartition(max(1, min(len(sizes), buckets // SPREAD)))
    hot = np.sort(np.array([r[0] for r in each.mapInArrow(_hot_words(vocabulary, n_tokens / (2 * buckets)), "id long").collect()], np.int64).view(np.uint64).astype(vocabulary.type))
    parts = max(1, min(buckets, n_tokens // (buckets * ROW_PAIRS)))
    pairs = table(texts.mapInArrow(_trigrams(vocabulary, hot), _ROW).groupBy("bucket").applyInArrow(_merge_trigrams(vocabulary, hot, parts), _ROW), "lm-trigrams")
    warm = table(pairs.where(F.col("kind") == HOT).groupBy("bucket").applyInArrow(_merge_hot(vocabulary, parts), _ROW), "lm-hot")
    every = pairs.unionByName(warm)
    before = table(every.where(F.col("kind") == BEFORE).groupBy("bucket").applyInArrow(_merge_before(vocabulary), _ROW), "lm-before")
    few = every.where(F.col("kind").isin(TRI_COUNTS, PAIR_COUNTS, OPENING)).unionByName(before).collect()  # a few numbers for each bucket
    added = lambda kind, n: sum((np.array(expand(bytes(r["data"]))).ravel() for r in few if r["kind"] == kind), np.zeros(n, _U64))
    n_seen = added(WORD_COUNTS, 6)
    stats = every.where(F.col("kind") == HOT_STATS).select("data").mapInArrow(_hot_stats, "v long, s0 long, s1 long, s2 long, s3 long")
    stats = sorted(stats.groupBy("v").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(4))).collect())  # the hot words
    have = {"tri": {r["bucket"] for r in few if r["kind"] == TRI_COUNTS}, "seen": {r["bucket"] for r in few if r["kind"] == WORD_COUNTS}}
    have |= {"ctx": have["tri"], "pair": have["tri"], "one": have["tri"], "hot": {r[0] for r in warm.where(F.col("kind") == HOT_STATS).select("bucket").collect()}}
    d = [discounts(added(TRI_COUNTS, 5)), discounts(added(PAIR_COUNTS, 5)), discounts(n_seen)]
    opening = added(OPENING, 4).astype(float)
    drop(pairs, warm, before)
    total = float(n_seen[5])
    spread = float(d[2][1] * n_seen[0] + d[2][2] * n_seen[1] + d[2][3] * n_seen[2:5].sum()) / total if total else 1.0
    keys = np.array([r["v"] for r in stats], np.int64).view(np.uint64).astype(vocabulary.type)
    order = np.argsort(keys)
    return Model(vocabulary, have, n_tokens, n_words, keys[order], [np.array([r[f"s{i}"] for r in stats], float)[order] for i in range(4)], opening, d, total, spread, parts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the files stay where they are; this is sizes and hot words

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_early()
        use = shared.value
        for batch in chunks(batches, limit=SCORE_CHUNK):
            out = use.score(words_of(batch))
            n = batch.num_rows
            out = {"n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": np.full(n, use.n_tokens), "base_score": out["base_score"], "score": out["score"]}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(v) for v in out.values())], names=["doc_id", "held_out", *out])

    return docs.select("doc_id", "held_out", "text").mapInArrow(go, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).withColumn("held_out", crc_mod("doc_id", 7) == 2)
    return score(docs, fit(docs.where(~F.col("held_out"))))
