"""Pieces that the corpus operators share: the shared work folder and word hashing over Arrow buffers.

Words are `[^\\x20\\x09-\\x0D]+` everywhere. Hashing is vectorised numpy over the UTF-8 buffer of a batch, so no Python
object is made per word; a batch is cut into chunks of a few MB first, which bounds a worker's memory whatever the number
of rows Spark puts into a batch.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
#: 64-bit hashing: mod 2**64 polynomials with odd bases over random byte codes, finished by an avalanche.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LIBC = ctypes.CDLL(None)
pa.set_memory_pool(pa.system_memory_pool())  # the default pool never shrinks; see trim()
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------------------------------------- folders and tables
def work_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A temporary one is set only where the setting is absent and all
    tasks run in this process, as in tests; on a cluster the setting is needed."""
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Limits of a batch that goes to Python, where the session still has Spark's own defaults. Documents are long: 10,000 rows or 64 MB
#: of them are held several times over, by the JVM's vectors and both ends of the pipe.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(spark: SparkSession) -> None:
    """Sets BATCHES for the session, which other queries of it see too; a session that has its own values keeps them. Also lets Python workers on this machine find the package wherever the driver was started."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, (default, own) in BATCHES.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, own)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df into the shared folder and reads it again: cuts lineage in a way that outlives executors. drop() removes it."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.work_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes written tables that no later result reads."""
    for t in tables:
        remove(t.sparkSession, t.work_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], wanted: tuple[str, ...]) -> list[str]:
    """The wanted names, each with as many "_" appended as it takes to differ from every input column."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


# -------------------------------------------------------------------------------------------------- files of arrays
_U64 = np.dtype("<u8")


def save(uri: str, *arrays: np.ndarray) -> None:
    """Header (number of arrays, then item size and length of each) and the arrays, of unsigned integers; a retry replaces the file
    whole."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], _U64)
    if uri.startswith(("file:", "/")):
        path = uri.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            for a in (head, *arrays):
                a.tofile(f)
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as f:
        for a in (head, *arrays):
            f.write(a.tobytes())


def load(uri: str) -> list[np.ndarray]:
    """The arrays, mapped into memory. A worker fetches the file once where the folder is not a mounted file system."""
    if uri.startswith(("file:", "/")):
        raw = np.memmap(uri.removeprefix("file://").removeprefix("file:"), np.uint8, "r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as own:
            with store.open_input_stream(path) as f:
                while part := f.read(1 << 24):
                    own.write(part)
            own.flush()
            raw = np.memmap(own, np.uint8, "r")
    n = int(raw[:8].view(_U64)[0])
    facts, at, out = raw[8 : 8 + 16 * n].view(_U64), 8 + 16 * n, []
    for size, length in zip(facts[::2].tolist(), facts[1::2].tolist()):
        out.append(raw[at : at + size * length].view(f"<u{size}"))
        at += size * length
    return out


# ------------------------------------------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, _BASE_INV if inverse else _BASE, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[key] = have
    return have[:n]


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair; equal sequences get equal hashes wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(values, powers(n), out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(n + 1, True)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """The words of a chunk of documents: byte bounds, document of each word, 64-bit hashes on demand."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        n = len(data)
        blank = _BLANK[data]
        before = np.ones(n, bool)
        after = np.ones(n, bool)
        if n:
            before[1:] = blank[:-1]
            after[:-1] = blank[1:]
            full = bounds[:-1] < bounds[1:]
            before[bounds[:-1][full]] = True
            after[bounds[1:][full] - 1] = True
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.starts, bounds)  # of each document, with the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        data = self.data if fold is None else fold[self.data]
        return ranges_hash(_CODES[data], self.starts, self.ends)

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string array; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    big = pa.types.is_large_string(array.type)
    buffers = array.buffers()
    bounds = np.frombuffer(buffers[1], np.int64 if big else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(array) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def trim() -> None:
    """Gives freed memory back: workers live on between tasks, and what they keep counts against their executor."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def release_early() -> None:
    """From now on this worker gives back every array of 1 MB or more when it is freed, where glibc would soon keep them all. For
    operators whose arrays are large; it costs CPU time (a fifth of what the token file takes)."""
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's text in each is at most limit bytes, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.fromiter((x or 0 for x in _lengths(batch.column(column))), np.int64, batch.num_rows))
        at = 0
        while at < batch.num_rows:
            used = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, used + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        trim()


def _lengths(array: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(array).to_pylist()


def words_of(batch: pa.RecordBatch, column: str = "text") -> Words:
    return Words(*text_buffer(batch.column(column)))


#: A-Z lowered, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
