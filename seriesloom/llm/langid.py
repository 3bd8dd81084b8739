"""Operator 7: language identification, word first with back-off to shorter character n-grams.

A model holds, per language, log frequencies of words and of character n-grams (4 down to 1, with word edges). A known word
scores its log frequencies; an unseen word scores those of its longest n-grams any of which is known; a word without a known
n-gram scores nothing. The languages' sums over the whole text, divided by the scored words and multiplied by
min(words, EVIDENCE), give the posterior that is returned as score.

The model is fitted on a bounded sample: of each language, however many there are, at most about MAX_DOCS labelled training
documents, chosen by the hash of their id (all if there are fewer), their whole texts; grams seen less than MIN_COUNT times are left
to the back-off, and MAX_GRAMS of each (kind, language) stay, the most frequent. Counting runs in Spark and grams travel as 64-bit
hashes. The model is sparse (a gram keeps the languages it was seen in; the others have the language's floor) and lies in the shared
folder, where workers map it into memory; languages are scored LANG_BLOCK at a time. The driver fetches 20 bytes an entry and
refuses more than MOST_ENTRIES (800 MB), thousands of languages, with an error.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any training row everything is `und`;
documents with a null language are only predicted; ties go to the language first by code point; a null doc_id hashes as the
empty text; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import chunks, crc_mod, load, mix, new_path, ranges_hash, read_documents, save

MAX_DOCS = 600
MAX_GRAMS = 40_000
LANG_BLOCK = 64
#: Languages whose sizes are sent to the tasks that draw the sample; more are joined.
MOST_LANGS = 100_000
MOST_ENTRIES = 40_000_000
MIN_COUNT = 2
LENGTHS = (4, 3, 2, 1)
EVIDENCE = 8
_OPEN: dict[str, Model] = {}
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def training_rows(docs: DataFrame, wanted) -> DataFrame:
    """(lang, text): the bounded sample of the rows that `wanted` allows."""
    labelled = docs.where(wanted & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.limit(MOST_LANGS + 1).count() <= MOST_LANGS
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(F.broadcast(sizes) if few else sizes, "lang").where(place * F.col("n") < MAX_DOCS).select("lang", "text")


class Letters:
    """The letter runs of lower-cased texts, as code points: bounds, document and hash of each."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        self.codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
        letter = is_letter(self.codes)
        edge = np.diff(letter.astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last character is no letter
        lasts = np.cumsum([len(t) + 1 for t in lowered])
        self.doc = np.searchsorted(lasts, self.starts, "right")
        self.hashes = ranges_hash(code_hash(self.codes), self.starts, self.ends)


_BMP = np.array([chr(i).isalpha() for i in range(1 << 16)])


def is_letter(codes: np.ndarray) -> np.ndarray:
    out = _BMP[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]).tolist():
        out[codes == c] = chr(c).isalpha()
    return out


def code_hash(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x1F123BB5)) | np.uint64(1)


def gram_hashes(grams: list[str]) -> np.ndarray:
    ends = np.cumsum([len(g) for g in grams])
    return ranges_hash(code_hash(np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)) if grams else np.zeros(0, np.uint64)


class Table:
    """Sorted gram hashes; of each its languages and log frequencies, from bounds; and each language's floor."""

    def __init__(self, hashes, bounds, langs, logs, floor):
        self.hashes, self.bounds, self.langs, self.logs, self.floor = hashes, bounds, langs, logs, floor

    @staticmethod
    def counted(hashes: np.ndarray, langs: np.ndarray, n: np.ndarray, n_langs: int) -> Table:
        """From (gram, language, count) entries. Half a sighting is added to every count."""
        order = np.lexsort((langs, hashes))
        hashes, langs, n = hashes[order], langs[order], n[order].astype(float)
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        total = np.bincount(langs, n, n_langs) + 0.5 * max(len(first), 1)
        return Table(hashes[first], np.append(first, len(hashes)).astype(np.uint64), langs.astype(np.uint32), (np.log(n + 0.5) - np.log(total[langs])).astype(np.float32), np.log(0.5 / total))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash, and whether it is known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def rows(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Log frequencies of these rows for the languages [low, high)."""
        out = np.tile(self.floor[low:high].astype(np.float32), (len(at), 1))
        first, last = (self.bounds[at + i].astype(np.int64) for i in (0, 1))
        many = last - first
        of = np.repeat(np.arange(len(at)), many)
        spot = np.arange(len(of)) + np.repeat(first - (np.cumsum(many) - many), many)
        lang = self.langs[spot].astype(np.int64)
        mine = (lang >= low) & (lang < high)
        out[of[mine], lang[mine] - low] = self.logs[spot[mine]]
        return out


class Model:
    """langs, and a table for each kind of gram ("w" or an n)."""

    def __init__(self, langs: list[str], tables: dict[str | int, Table]):
        self.langs, self.tables = langs, tables

    def save(self, path: str) -> None:
        save(path, *(x.view(np.uint32 if x.itemsize == 4 else np.uint64) for k in ("w", *LENGTHS) for x in vars(self.tables[k]).values()))

    @staticmethod
    def load(path: str, langs: list[str]) -> Model:
        if path not in _OPEN:
            _OPEN.clear()
            found = load(path)
            parts = [found[i : i + 5] for i in range(0, len(found), 5)]
            _OPEN[path] = Model(langs, {k: Table(h, b, x, p.view(np.float32), f.view(np.float64)) for k, (h, b, x, p, f) in zip(("w", *LENGTHS), parts)})
        return _OPEN[path]

    def words(self, text: Letters, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of the distinct words at these places for languages [low, high), and which words have any."""
        out = np.zeros((len(at), high - low), np.float32)
        rows, done = self.tables["w"].find(text.hashes[at])
        out[done] = self.tables["w"].rows(rows[done], low, high)
        for n in LENGTHS:
            left = np.flatnonzero(~done)
            if not len(left):
                break
            pad = 1 if n > 1 else 0
            length = text.ends[at[left]] - text.starts[at[left]]
            first = np.cumsum(length + 2 * pad) - (length + 2 * pad)
            codes = np.full(int((length + 2 * pad).sum()), ord(" "), np.uint32)
            step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            codes[np.repeat(first + pad, length) + step] = text.codes[np.repeat(text.starts[at[left]], length) + step]
            many = np.maximum(length + 2 * pad - n + 1, 0)
            of = np.repeat(np.arange(len(left)), many)
            spot = np.repeat(first, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            rows, known = self.tables[n].find(ranges_hash(code_hash(codes), spot, spot + n))
            of, rows = of[known], rows[known]
            if len(of):
                edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                out[left[of[edge]]] = np.add.reduceat(self.tables[n].rows(rows, low, high), edge, axis=0) / np.diff(np.append(edge, len(of)))[:, None]
                done[left[of[edge]]] = True
        return out, done

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        text, k = Letters(texts), len(self.langs)
        if not len(text.starts) or not k:
            return ["und"] * len(texts), np.zeros(len(texts))
        _, first, inverse = np.unique(text.hashes, return_index=True, return_inverse=True)
        edge = np.flatnonzero(np.append(True, text.doc[1:] != text.doc[:-1]))
        docs = text.doc[edge]
        total, n = np.zeros((len(texts), k)), np.zeros(len(texts))
        for low in range(0, k, LANG_BLOCK):
            high = min(low + LANG_BLOCK, k)
            logs, known = self.words(text, first, low, high)
            for x in range(low, high):
                total[docs, x] = np.add.reduceat(logs[:, x - low].astype(np.float64)[inverse], edge)
            n[docs] = np.add.reduceat(known[inverse].astype(float), edge)
        total *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        has = np.zeros(len(texts), bool)
        has[docs] = True
        return [self.langs[b] if h else "und" for b, h in zip(best, has)], np.where(has, p.max(axis=1) / p.sum(axis=1), 0.0)


def fit(docs: DataFrame, wanted) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            out: Counter = Counter()
            for lang, words in held.items():
                for word, n in words.items():
                    out[lang, "w", word] += n
                    for k in LENGTHS:
                        for g in grams(word, k):
                            out[lang, str(k), g] += n
            held.clear()
            keys = list(out)
            hashes = gram_hashes([k[2] for k in keys]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(hashes, pa.int64()), pa.array(list(out.values()), pa.int64())], names=["lang", "kind", "gram", "n"])

        for batch in chunks(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
            if sum(map(len, held.values())) > 200_000:
                yield rows()
        if held:
            yield rows()

    counted = training_rows(docs, wanted).mapInArrow(count, "lang string, kind string, gram long, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= MAX_GRAMS).select("lang", "kind", "gram", "n")
    found = best.limit(MOST_ENTRIES + 1).toArrow()
    if found.num_rows > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries; lang holds something else than languages")
    langs = sorted(set(found.column("lang").unique().to_pylist()))
    lang = pc.index_in(found.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    gram, n, tables = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy(), {}
    for kind in ("w", *LENGTHS):
        mine = pc.equal(found.column("kind"), str(kind)).to_numpy()
        tables[kind] = Table.counted(gram[mine], lang[mine], n[mine], len(langs))
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    path, langs = new_path(docs.sparkSession, "langid"), model.langs
    model.save(path)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Model.load(path, langs)
        for batch in chunks(batches):
            found, score = use.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(go, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return predict(docs, fit(docs, ~F.col("held_out")))
