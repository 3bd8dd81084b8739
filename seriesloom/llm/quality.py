"""Operator 9: quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated output.

Each token has a fixed sparse ternary index vector drawn from its hash; a vocabulary token's word vector is the normalised sum
of the index vectors of its neighbours in the training sample, weighted down by their frequency. The tokens of a text are its
lower-case words, their shapes (letter case, digits and punctuation with runs collapsed) and a mark for a word that repeats the
one before. A text is the mean vector of its words beside that of its shapes, their norms and its log length; a ReLU layer and
a logistic output give the logit, which a temperature fitted on a validation fold turns into a probability.

The whole classifier is fitted on a bounded sample: about MAX_DOCS labelled rows chosen by the hash of their id (all if there
are fewer), whole texts, MAX_VOCABULARY tokens. The sample is written once, in SAMPLE_PARTS parts, so documents are read once to
learn and once to score. Neighbours' index vectors are added as integers, in the tasks and then in Spark: the model does not depend
on how rows are dealt. Scoring reads every whole text; it sends the tasks the model, whose size the parameters bound.

Defined cases: null and empty texts are scored (all features zero); labels repeated for a document are averaged and rounded,
null labels ignored; without both labels the score is the share of label 1, or 0.5; a null doc_id hashes as the empty text and
carries no label; repeated rows are scored alike; other columns are ignored, and `keep` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _CODES, LOWER, Words, chunks, crc_mod, drop, mix, ranges_hash, read_documents, table, text_buffer

MAX_DOCS, SAMPLE_PARTS = 12_000, 16
MAX_VOCABULARY = 30_000
MIN_COUNT = 5
DIM = 24
NONZERO = 4
SPAN = 2
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
#: Index vectors in integers of 2 ** -FIXED.
FIXED = 20
_REPEAT = np.uint64(0x5265706561740001)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def token_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its lower-case hash, and that of its shape, or the mark of a repetition."""
    plain = words.hashes(LOWER)
    kinds = _SHAPE[words.data]
    lead = np.ones(len(kinds), bool)
    if len(kinds):
        lead[1:] = kinds[1:] != kinds[:-1]
        lead[words.starts] = True
    at = np.concatenate([[0], np.cumsum(lead)])
    shapes = ranges_hash(_CODES[kinds[lead]], at[words.starts], at[words.ends]) ^ np.uint64(0xABCDEF)
    if len(plain) > 1:
        again = np.flatnonzero((plain[1:] == plain[:-1]) & (words.doc[1:] == words.doc[:-1])) + 1
        shapes[again] = _REPEAT
    return plain, shapes


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), DIM), np.float32)
    rows = np.arange(len(hashes))
    for k in range(NONZERO):
        h = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        np.add.at(out, (rows, (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0))
    return out


class Model:
    def __init__(self, keys: np.ndarray, vectors: np.ndarray, scale=None, layers=None, temperature: float = 1.0, share: float = 0.5):
        self.keys, self.vectors, self.scale, self.layers, self.temperature, self.share = keys, vectors, scale, layers, temperature, share

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each token in vectors; the last row, zeros, for one outside the vocabulary."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def features(self, words: Words) -> np.ndarray:
        n = np.maximum(words.counts, 1).astype(np.float32)[:, None]
        parts = []
        for hashes in token_hashes(words):
            pooled = np.zeros((len(words.counts), DIM), np.float32)
            rows = self.rows(hashes)
            known = np.flatnonzero(rows < len(self.keys))
            if len(known):
                docs = words.doc[known]
                firsts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
                pooled[docs[firsts]] = np.add.reduceat(self.vectors[rows[known]], firsts, axis=0)
            pooled /= n
            parts += [pooled, np.linalg.norm(pooled, axis=1, keepdims=True)]
        return np.concatenate([*parts, np.log1p(words.counts)[:, None]], axis=1).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, std = self.scale
        (w1, b1), (w2, b2) = self.layers
        return np.maximum((x - mean) / std @ w1 + b1, 0) @ w2 + b2

    def score(self, words: Words) -> np.ndarray:
        if self.layers is None:
            return np.full(len(words.counts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(words))[:, 0].astype(float) / self.temperature, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, wanted) -> DataFrame:
    """(doc_id, quality, text) of about MAX_DOCS labelled rows."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality")).where(wanted)
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, MAX_DOCS / max(n, 1)) * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # a bounded number of ids


def fit(docs: DataFrame, labels: DataFrame, wanted) -> Model:
    spark = docs.sparkSession
    sample = table(labelled_sample(docs, labels, wanted).repartition(SAMPLE_PARTS, F.xxhash64("doc_id", "text")), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(*text_buffer(batch.column("text")))
            key, n = np.unique(np.concatenate(token_hashes(words)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    counts = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "key").limit(MAX_VOCABULARY).toPandas()
    keys = counts["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, freq = keys[order], counts["n"].to_numpy()[order].astype(float)
    weight = (1 / np.sqrt(freq)).astype(np.float32)[:, None]
    drawn = np.concatenate([index_vectors(keys) * weight, np.zeros((1, DIM), np.float32)])
    bare = spark.sparkContext.broadcast(Model(keys, np.rint(drawn * (1 << FIXED)).astype(np.int64)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = bare.value, None
        for batch in chunks(batches):
            words = Words(*text_buffer(batch.column("text")))
            streams = [model.rows(h) for h in token_hashes(words)]
            total = np.zeros((len(model.keys) + 1, DIM), np.int64) if total is None else total
            for mine in streams:
                for other in streams:
                    for gap in range(-SPAN, SPAN + 1):
                        a = np.arange(max(0, -gap), len(words) - max(0, gap))
                        a = a[words.doc[a] == words.doc[a + gap]] if gap else (a if mine is not other else a[:0])
                        _add(total, mine[a], model.vectors, other[a + gap])
        if total is not None:
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(total[rows, i]) for i in range(DIM))], names=["row", *(f"v{i}" for i in range(DIM))])

    parts = sample.mapInArrow(contexts, "row long, " + ", ".join(f"v{i} long" for i in range(DIM)))
    sums = parts.groupBy("row").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM))).toArrow()  # MAX_VOCABULARY x DIM at most
    total = np.zeros((len(keys) + 1, DIM), np.float64)
    if sums.num_rows:
        total[sums.column("row").to_numpy()] = np.stack([sums.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1)
    vectors = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    vectors[-1] = 0
    model = Model(keys, vectors)
    ready = spark.sparkContext.broadcast(model)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = ready.value.features(Words(*text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    rows = sample.mapInArrow(pooled, "doc_id long, quality int, x array<float>").orderBy("doc_id", "x").toPandas()
    drop(sample)
    train(model, np.stack(rows["x"]) if len(rows) else np.zeros((0, 2 * DIM + 3), np.float32), rows["quality"].to_numpy(float))
    return model


def _add(total: np.ndarray, rows: np.ndarray, vectors: np.ndarray, others: np.ndarray) -> None:
    """total[rows] += vectors[others], by pairs counted first."""
    if not len(rows):
        return
    pair, n = np.unique(rows * len(vectors) + others, return_counts=True)
    row, other = np.divmod(pair, len(vectors))
    firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    total[row[firsts]] += np.add.reduceat(vectors[other] * n[:, None], firsts, axis=0)


def train(model: Model, x: np.ndarray, y: np.ndarray, seed: int = 1) -> None:
    """Adam on the log loss over all but every fifth row, whose log loss then fixes the temperature."""
    model.share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return
    rng = np.random.default_rng(seed)
    check = np.arange(len(y)) % 5 == 4
    xt, yt = x[~check], y[~check]
    model.scale = xt.mean(axis=0), xt.std(axis=0) + 1e-3
    z = (xt - model.scale[0]) / model.scale[1]
    params = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for mine in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // 256)):
            a, target = z[mine], yt[mine][:, None]
            hidden = np.maximum(a @ params[0] + params[1], 0)
            d = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - target) / len(mine)
            back = (d @ params[2].T) * (hidden > 0)
            t += 1
            for i, g in enumerate((a.T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ d + 1e-4 * params[2], d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model.layers = [(params[0].astype(np.float32), params[1].astype(np.float32)), (params[2].astype(np.float32), params[3].astype(np.float32))]
    if check.any():
        logits, target = model.logits(x[check])[:, 0].astype(float), y[check]
        losses = {c: np.mean(np.logaddexp(0, -np.where(target > 0, 1, -1) * logits / c)) for c in np.exp(np.linspace(-1, 2, 61))}
        model.temperature = float(min(losses, key=losses.get))


def score(docs: DataFrame, model: Model, names: list[str] | None = None, into: str = "score") -> DataFrame:
    """The columns `names` (doc_id if none) and the score of each row."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), names or ["doc_id"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = shared.value.score(Words(*text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s, pa.float64())], names=[*names, into])

    from pyspark.sql.types import DoubleType, StructField, StructType

    picked = docs.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*names, "text"])])
    return picked.mapInArrow(go, StructType([*(picked.schema[n] for n in names), StructField(into, DoubleType())]))


def keep(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    into = "score"
    while into in docs.columns:
        into += "_"
    return score(docs, model, docs.columns, into).where(F.col(into) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = fit(docs, read_documents(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = score(docs.withColumn("held_out", crc_mod("doc_id", 5) == 0), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
