"""Operator 4: token ids in a word-aligned binary file (Simple-8b).

A file is a folder of blocks in the shared store, one row a block: part, block, first (ids of the part before the block), the
block's document ids, their token counts, and the payload. The payload is

    u32 magic, u32 ids, u32 words, u32 escapes, u32 groups, then
    u64 words[]     4-bit selector, 60 bits of ids, lowest first
    u64 escapes[]   values of more than 60 bits; their word has selector 0 and the index into this list
    u32 groups[]    for every GROUP ids the index of their first word (no word crosses a group), so any group decodes alone

Selectors pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of 1 to 60 bits. Packing is greedy and runs over all
groups of a block at once in numpy; decoding is one numpy expression over all words. Documents are range-partitioned and
sorted by doc_id (nulls first, ties by text), so parts in order are the corpus in order; a part's tasks stream blocks of about
BLOCK_IDS ids and hold no more.

Texts are split with the vocabulary's own boundary rule into units (a word with the space before it, or white space); each
distinct unit goes through the tokenizers library once per worker. No token crosses such a boundary, so the ids are those
of the whole text; a text with a special token or white space outside ASCII in it is encoded whole.

Defined cases: a null or empty text has the end id alone; ids of any size up to 64 bits round-trip; repeated and null doc_ids
are documents of their own; an empty table is a file without blocks; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import _CODES, Words, chunks, new_path, ranges_hash, read_documents, text_buffer

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
BLOCK_IDS = 1 << 19
GROUP = 1024
MAGIC = 0x53384231
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)  # by selector; 0 is an escape
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
#: Unicode white space, as the vocabulary's pre-tokenizer has it.
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WIDTH = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)
_ODD_WHITE = re.compile("|".join(c for c in _WHITE if ord(c) > 127).encode())
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CODES = np.zeros(256, np.uint32)
_BYTE_CODES[_PRINTABLE] = _PRINTABLE
_BYTE_CODES[[b for b in range(256) if b not in set(_PRINTABLE)]] = 256 + np.arange(256 - len(_PRINTABLE))
#: Bytes that can be part of a letter; what is beyond ASCII is looked at as text.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
CACHE_UNITS = 800_000
MOST_NEW = 400_000
ENCODE_CHUNK = 1 << 20
#: ASCII punctuation but for the apostrophe, which can begin a pre-token of letters.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
BLOCK_SCHEMA = "part int, block int, first long, doc_ids array<long>, n_tokens array<long>, payload binary"


# ------------------------------------------------------------------------------------------------------------ codec
def pack(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    groups = max(1, -(-n // GROUP))
    wide = ids >= np.uint64(1 << 60)
    if n and ids.max() < 1 << 16:
        width = _WIDTH[ids.astype(np.uint16)]
    else:
        width = np.searchsorted(np.left_shift(np.uint64(1), np.arange(60, dtype=np.uint64)), ids, "right").astype(np.uint8)
        width[wide] = 64
    left = np.tile(np.arange(GROUP, 0, -1, dtype=np.int16), groups)[:n]  # ids to the end of the group
    if n % GROUP:
        left[n - n % GROUP :] -= GROUP - n % GROUP
    selector = np.full(n, 14, np.uint8)
    widest = width  # over the last count of ids looked at
    before = 1
    for s in range(13, 0, -1):  # from pairs upwards: the densest that fits wins
        c = int(COUNTS[s])
        if n < c:
            break
        widest = np.maximum(widest[: n - c + 1], widest[c - before : n - before + 1])
        before = c
        fits = (widest <= BITS[s]) & (left[: n - c + 1] >= c)
        if not fits.any():
            break  # then nothing denser fits either
        np.copyto(selector[: n - c + 1], s, where=fits)
    selector[wide] = 0
    selector = selector.astype(np.int64)
    taken = COUNTS[selector]
    at = np.arange(0, n, GROUP)
    stop = np.minimum(at + GROUP, n)
    marked = np.zeros(n, bool)
    while len(at):  # one step packs a word of every group
        marked[at] = True
        at = at + taken[at]
        alive = at < stop
        at, stop = at[alive], stop[alive]
    starts = np.flatnonzero(marked)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    if n:
        sizes = np.diff(np.append(starts, n))
        shift = (np.arange(n) - np.repeat(starts, sizes)) * np.repeat(BITS[chosen], sizes)
        words |= np.add.reduceat(np.where(wide, np.uint64(0), ids) << shift.astype(np.uint64), starts)
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(starts, np.arange(groups) * GROUP).astype("<u4")
    return struct.pack("<5I", MAGIC, n, len(words), len(escaped), groups) + words.astype("<u8").tobytes() + ids[starts[escaped]].astype("<u8").tobytes() + offsets.tobytes()


def unpack(data: bytes, group: int | None = None) -> np.ndarray:
    """All ids of a payload, or those of one group."""
    magic, n, n_words, n_escapes, groups = struct.unpack_from("<5I", data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    words = np.frombuffer(data, "<u8", n_words, 20)
    escapes = np.frombuffer(data, "<u8", n_escapes, 20 + 8 * n_words)
    if group is not None:
        offsets = np.append(np.frombuffer(data, "<u4", groups, 20 + 8 * (n_words + n_escapes)), n_words)
        words = words[offsets[group] : offsets[group + 1]]
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.cumsum(counts) - counts
    shift = (np.arange(counts.sum()) - np.repeat(first, counts)) * np.repeat(BITS[selector], counts)
    mask = (np.uint64(1) << BITS[selector].astype(np.uint64)) - np.uint64(1)
    out = (np.repeat(words, counts) >> shift.astype(np.uint64)) & np.repeat(mask, counts)
    if n_escapes:
        spots = np.flatnonzero(selector == 0)
        out[first[spots]] = escapes[(words[spots] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


# --------------------------------------------------------------------------------------------------------- encoding
def unit_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the units in a chunk's bytes, in order, and which are white space. A word takes the space right before it;
    of the white space before a word all but the last character is a unit, and the last one too unless the word took it."""
    words = Words(data, bounds)
    s, e = words.starts, words.ends
    before = np.append(0, e[:-1])[: len(s)]
    leads = words.first[:-1][words.counts > 0]
    before[leads] = bounds[:-1][words.counts > 0]
    gap = s - before
    took = (gap > 0) & (data[s - 1] == 0x20)
    many, own = gap >= 2, (gap >= 1) & ~took
    last = bounds[:-1].copy()
    last[words.counts > 0] = e[words.first[1:][words.counts > 0] - 1]
    rest = last < bounds[1:]
    starts = np.concatenate([s - took, before[many], s[own] - 1, last[rest]])
    ends = np.concatenate([e, s[many] - 1, s[own], bounds[1:][rest]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], (np.arange(len(starts)) >= len(s))[order]


class HashTable:
    """64-bit keys to small numbers by open addressing, many at a time; keys are hashes already."""

    def __init__(self, size: int):
        self.mask = np.uint64((1 << int(np.ceil(np.log2(2 * size)))) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.full(int(self.mask) + 1, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            value = self.values[slot]
            hit = (self.keys[slot] == keys[left]) & (value >= 0)
            out[left[hit]] = value[hit]
            on = ~hit & (value >= 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys: all write to a free slot they want, who finds its key there is done, the others move on."""
        slot = keys & self.mask
        while len(keys):
            free = self.values[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + np.uint64(1)) & self.mask


class Encoder:
    """Ids of whole texts through the tokenizers library, each distinct unit once. Units are found and told apart by hash in
    numpy. A new unit of letters, marks or both is one or two pre-tokens and goes straight to the library's BPE model, in the
    byte-level alphabet; others go through its whole pipeline many at a time, parted by a line feed, which is a token of its own."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self._ids(["\n"])[0]
        self.clear()

    def clear(self) -> None:
        self.known, self.many = HashTable(CACHE_UNITS + MOST_NEW), 0
        self.ends: dict[str, list[int]] = {}
        self.starts, self.counts, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        self.size = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.insert(hashes, self.many + np.arange(len(hashes)))
        self.many += len(hashes)
        self.starts.append(self.size + np.cumsum(counts) - counts)
        self.counts.append(counts)
        self.ids.append(ids)
        self.size += len(ids)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts one after another, and how many each has."""
        raw = data.tobytes()
        starts, ends, blank = unit_spans(data, bounds)
        whole = np.zeros(len(bounds) - 1, bool)
        if _ODD_WHITE.search(raw) or any(s.encode() in raw for s in self.specials):
            texts = [raw[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            whole = np.array([bool(_ODD_WHITE.search(t)) or any(s.encode() in t for s in self.specials) for t in texts])
            stay = ~whole[np.searchsorted(bounds, starts, "right") - 1]
            starts, ends, blank = (np.concatenate([x[stay], y]) for x, y in ((starts, bounds[:-1][whole]), (ends, bounds[1:][whole]), (blank, np.ones(whole.sum(), bool))))
            order = np.argsort(starts, kind="stable")
            starts, ends, blank = starts[order], ends[order], blank[order]
        hashes = ranges_hash(_CODES[data], starts, ends)
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1]) if len(order) else np.zeros(0, bool)
        keys, first = hashes[new], order[new]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if self.many > CACHE_UNITS or len(keys) > MOST_NEW:
            self.clear()
            if len(keys) > MOST_NEW:  # a giant document
                self.known = HashTable(len(keys))
        rows = self.known.find(keys)
        fresh = np.flatnonzero(rows < 0)
        rows[fresh] = self.many + np.arange(len(fresh))
        a, b = starts[first[fresh]], ends[first[fresh]]
        # [space] letters, then marks: at most two pre-tokens, which go straight to the model
        lead = data[np.minimum(a, len(data) - 1)] == 0x20 if len(a) else np.zeros(0, bool)
        other = np.append(np.flatnonzero(~_LETTER[data]), len(data))
        stem = np.minimum(other[np.searchsorted(other, a + lead)], b)
        marks = np.concatenate([[0], np.cumsum(_MARK[data], dtype=np.int64)])
        wide = np.concatenate([[0], np.cumsum(data >= 0x80, dtype=np.int64)])
        plain = ~blank[first[fresh]] & (marks[b] - marks[stem] == b - stem) & (b - a > lead)
        for i in np.flatnonzero(plain & (wide[b] > wide[a])).tolist():
            plain[i] = raw[a[i] + lead[i] : stem[i]].decode().isalpha()
        mapped = _BYTE_CODES[data].tobytes().decode("utf-32-le") if plain.any() else ""
        tokenize = self.tokenizer.model.tokenize
        found: list[list[int]] = [[]] * len(fresh)
        ending = self.ends
        for i, x, y, z, bare in zip(np.flatnonzero(plain).tolist(), a[plain].tolist(), stem[plain].tolist(), b[plain].tolist(), (stem == a + lead)[plain].tolist()):
            if bare or y == z:
                found[i] = [t.id for t in tokenize(mapped[x:z])]
            else:
                end = mapped[y:z]
                if end not in ending:
                    ending[end] = [t.id for t in tokenize(end)]
                found[i] = [t.id for t in tokenize(mapped[x:y])] + ending[end]
        for alone in (False, True):
            mine = np.flatnonzero(~plain & (blank[first[fresh]] == alone)).tolist()
            for low in range(0, len(mine), 4096):
                part = mine[low : low + 4096]
                units = [raw[a[i] : b[i]].decode() for i in part]
                if alone:
                    got = self._ids(units)
                else:
                    ids = self._ids(["\n".join([*units, ""])])[0]
                    marks = [-1, *(i for i, x in enumerate(ids) if x == self.mark)]
                    got = [ids[x + 1 : y] for x, y in zip(marks, marks[1:])]
                for i, x in zip(part, got):
                    found[i] = x
        if len(fresh):
            self._learn(keys[fresh], np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        self.starts, self.counts, self.ids = [np.concatenate(self.starts)], [np.concatenate(self.counts)], [np.concatenate(self.ids)]
        rows = rows[inverse]
        counts = self.counts[0][rows]
        last = np.cumsum(counts)
        ids = self.ids[0][np.repeat(self.starts[0][rows] - (last - counts), counts) + np.arange(int(last[-1]) if len(last) else 0)]
        total = np.append(0, last)[np.searchsorted(starts, bounds)]
        return ids, np.diff(total)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker: its unit cache serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stored_order(docs: DataFrame) -> list[Column]:
    """Sort keys that keep the order in which a sorted DataFrame was written: part number, file and row of a file scan; the order of
    the partitions' rows where docs is none."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    name = F.col("_metadata.file_name")
    return [F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0)), name, F.col("_metadata.row_index")]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, partitions: int | None = None, order: list[Column] | None = None) -> None:
    """The file of all texts in the given order, by default ascending doc_id; rows of one doc_id by their texts' hashes, so that no
    id lands whole in one part."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block, first = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs_of: list[int | None] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            row = [part, block, first, docs_of, counts, pack(np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["part", "block", "first", "doc_ids", "n_tokens", "payload"])

        held = 0
        for batch in chunks(batches, limit=ENCODE_CHUNK):
            found, many = code.encode(*text_buffer(batch.column("text")))
            ids.append(np.insert(found, np.cumsum(many), np.uint32(end_id)))
            docs_of += batch.column("doc_id").to_pylist()
            counts += (many + 1).tolist()
            held += len(ids[-1])
            if held >= BLOCK_IDS:
                yield flush()
                block, first, held, ids, docs_of, counts = block + 1, first + held, 0, [], [], []
        if ids:
            yield flush()

    keys = [k.alias(f"k{i}") for i, k in enumerate(order or [F.col("doc_id").cast("long"), F.xxhash64("text")])]
    names = [f"k{i}" for i in range(len(keys))]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).repartitionByRange(partitions, *names).sortWithinPartitions(*names, "text")
    placed.select("doc_id", "text").mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document from the file: doc_id, start, n_tokens, ids_crc32, and with ids the ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    bases = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases = bases.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def decode(batches):
        for batch in batches:
            for base, first, doc_ids, counts, data in zip(*(batch.column(c).to_pylist() for c in ("base", "first", "doc_ids", "n_tokens", "payload"))):
                found = unpack(data).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                raw = memoryview(found).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(base + first + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    placed = blocks.join(F.broadcast(bases), "part")  # bases: a row for each part, whose number the writer's parameter sets
    return placed.select("base", "first", "doc_ids", "n_tokens", "payload").mapInArrow(decode, schema)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(read_documents(spark, sf_dir), path)
    return read_tokens(spark, path)
