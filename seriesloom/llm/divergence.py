"""Operator 2: quality rules by distribution divergence.

References are counted over all documents that name a language, for every language with MIN_REFERENCE words (a histogram of fewer
words says nothing): per language a histogram of character classes and the TOP most common words (lower case) with the rest as one
more cell. A document is compared with every reference by the
Jensen-Shannon distance (base 2) of both histograms and fails if, even against its nearest language, one of them is over its
limit. The squared limit is a base squared plus the divergence that sampling alone gives a text of that length, cells / (8 n ln
2); texts under the guards' length are not judged by that histogram at all.

Word counts are exact: tasks send each distinct (language, word hash) once with its count and Spark sums them. The references,
under 500 bytes a language, are fetched and sent to the tasks after their number is checked; more than MOST_SENT (32 MB), which no
set of human languages reaches, are refused with an error, not cut.

Defined cases: a null or empty text has no words and fails the base rule (fewer than MIN_WORDS words); documents without a
language, or of one too small for a reference, are judged like others; without any reference only the base rules decide; repeated
rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOWER, Words, chunks, ranges_hash, read_documents, text_buffer

TOP = 40
MIN_REFERENCE, MOST_SENT = 100, 65_536
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Guards and base limits of the two histograms.
MIN_CLASS_CHARS, CLASS_LIMIT = 150, 0.22
MIN_COMMON_WORDS, COMMON_LIMIT = 50, 0.25
SYMBOLS = b"#*$%&|<>"
#: Character classes by byte; a multi-byte character counts once, by its first byte.
CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(9, 14)]] = 3
_CLASS[list(b".,;:?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[ord("!")] = 8  # on its own: prose has few, so their share tells shouting from sentences, which other marks would drown
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 255  # continuation
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
HELD = 1_000_000


def class_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Characters of each class, by document."""
    out = np.zeros((len(bounds) - 1, CLASSES), np.int64)
    kinds = _CLASS[data]
    for c in range(CLASSES):
        total = np.concatenate([[0], np.cumsum(kinds == c)])
        out[:, c] = total[bounds[1:]] - total[bounds[:-1]]
    return out


def base(words: Words, texts: list[str | None]) -> dict[str, np.ndarray]:
    """The base columns, by document."""
    n = len(words.counts)
    chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    in_word = np.concatenate([[0], np.cumsum(chars[words.ends] - chars[words.starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": in_word[words.first[1:]] - in_word[words.first[:-1]],
        "n_symbols": symbols[words.bounds[1:]] - symbols[words.bounds[:-1]],
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    for i, text in enumerate(texts):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    hashes = words.hashes()
    starts = np.arange(max(0, len(words) - 4))
    starts = starts[words.doc[starts] == words.doc[starts + 4]] if len(starts) else starts
    if len(starts):
        keys = ranges_hash(hashes, starts, starts + 5) ^ (words.doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = starts[counts[inverse] > 1]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 5, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        out["n_repeat_words"] = covered[words.first[1:]] - covered[words.first[:-1]]
    return out


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """language -> class shares, sorted hashes of its TOP words, shares of these and of the rest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        classes: dict[str, np.ndarray] = {}

        def rows(lang: str, key: np.ndarray, n: np.ndarray, kind: str) -> pa.RecordBatch:
            k = len(key)
            return pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([kind] * k), pa.array(key.astype(np.int64, copy=False)), pa.array(n.astype(np.int64))], names=["lang", "kind", "key", "n"])

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return key, np.bincount(inverse, np.concatenate([p[1] for p in parts]))

        for batch in chunks(batches):
            data, bounds = text_buffer(batch.column("text"))
            words = Words(data, bounds)
            hashes, per_doc = words.hashes(LOWER), class_counts(data, bounds)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                mine = langs == lang
                classes[lang] = classes.get(lang, 0) + per_doc[mine].sum(axis=0)
                parts = held.setdefault(lang, [])
                parts.append(np.unique(hashes[mine[words.doc]], return_counts=True))
                if sum(len(p[0]) for p in parts) > HELD:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield rows(lang, *parts.pop(), "word")
        for lang, parts in held.items():
            if parts:
                key, n = merged(parts)
                yield rows(lang, key.view(np.int64), n, "word")
            yield rows(lang, np.arange(CLASSES), classes[lang], "class")

    sent = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = sent.mapInArrow(count, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))).where(F.col("place") <= TOP)
    totals = docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).where(F.col("words") >= MIN_REFERENCE)
    rows = ranked.join(totals, "lang").groupBy("lang", "words").agg(*(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n"))).alias(kind) for kind in ("class", "word")))  # TOP and CLASSES at most
    found = rows.limit(MOST_SENT + 1).collect()
    if len(found) > MOST_SENT:
        raise ValueError(f"more than {MOST_SENT} languages have references; lang holds something else")
    out = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        shares = np.zeros(CLASSES)
        shares[[x["key"] for x in r["class"]]] = [x["n"] for x in r["class"]]
        keys = np.array([x["key"] for x in r["word"]], np.int64).view(np.uint64)
        order = np.argsort(keys)
        cells = np.array([x["n"] for x in r["word"]], float)[order] / r["words"]
        out[r["lang"]] = shares / shares.sum(), keys[order], np.append(cells, max(0.0, 1 - cells.sum()))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q, base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def distances(words: Words, refs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document to its nearest reference (by the mean of both): class distance, common-word distance, characters."""
    classes = class_counts(words.data, words.bounds)
    n_chars, n_words = classes.sum(axis=1), words.counts
    hashes = words.hashes(LOWER)
    best = np.full((3, len(n_words)), np.inf)
    p = classes / np.maximum(n_chars, 1)[:, None]
    for shares, keys, cells in refs.values():
        counts = np.zeros((len(n_words), len(cells)))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[at] == hashes
            np.add.at(counts, (words.doc[hit], at[hit]), 1)
        counts[:, -1] = n_words - counts[:, :-1].sum(axis=1)
        a, b = js_distance(p, shares), js_distance(counts / np.maximum(n_words, 1)[:, None], cells)
        nearer = a + b < best[2]
        best[:, nearer] = np.stack([a, b, a + b])[:, nearer]
    return best[0], best[1], n_chars


def judge(docs: DataFrame, refs: dict) -> DataFrame:
    """doc_id, base columns, base_failed, class_distance, word_distance (null where guarded), kept."""
    limits, sent = (CLASS_LIMIT, COMMON_LIMIT), docs.sparkSession.sparkContext.broadcast(refs)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(*text_buffer(batch.column("text")))
            out = base(words, batch.column("text").to_pylist())
            n = out["n_words"]
            failed = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n)
            a, b, n_chars = distances(words, sent.value)
            with np.errstate(divide="ignore"):
                over_a = a**2 > limits[0] ** 2 + CLASSES / (8 * np.log(2) * np.maximum(n_chars, 1))
                over_b = b**2 > limits[1] ** 2 + (TOP + 1) / (8 * np.log(2) * np.maximum(n, 1))
            judged_a, judged_b = (n_chars >= MIN_CLASS_CHARS) & np.isfinite(a), (n >= MIN_COMMON_WORDS) & np.isfinite(b)
            kept = ~failed & ~(judged_a & over_a) & ~(judged_b & over_b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in out.values()), pa.array(failed), pa.array(a, mask=~judged_a), pa.array(b, mask=~judged_b), pa.array(kept)],
                names=["doc_id", *out, "base_failed", "class_distance", "word_distance", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean")


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return judge(docs, references(docs))
