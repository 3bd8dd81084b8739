"""Small corpora for the operators' tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHES = ("row", "rid", "key", "label", "size", "target", "position", "src", "absent", "spans", "kept_text", "toks", "w", "h", "score", "held_out", "bad", "first")


def words(rnd, n, vocabulary=400, lang="en"):
    return [f"{lang}{rnd.randrange(vocabulary)}{rnd.choice('aeiou')}" for _ in range(n)]


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages, repeated lines."""
    rnd = random.Random(seed)
    passage = " ".join(words(rnd, 70))
    texts = []
    for i in range(n):
        w = words(rnd, rnd.choice([3, 20, 60, 150]))
        lines = [" ".join(w[j : j + 12]) for j in range(0, len(w), 12)]
        if i % 3 == 0:
            lines.append("  Common FOOTER line\t")
        if i % 5 == 0:
            lines.insert(len(lines) // 2, passage)
        texts.append("\n".join(lines))
    texts += [texts[5], texts[5], texts[7] + " tail", texts[10].replace("en1", "xx1", 1)]
    long = words(rnd, 150)
    for i in range(6):
        near = list(long)
        near[rnd.randrange(150)] = f"edit{i}"
        texts.append(" ".join(near))
    return texts


def messy(spark, texts=None, clash=True):
    """A table with nulls in every column, empty and white texts, repeated rows, a very long text and clashing columns."""
    rnd = random.Random(1)
    texts = corpus() if texts is None else texts
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \n\t ", "en", "s1", 4), (None, "no id here at all", None, "s1", 1), (n + 3, " ".join(words(rnd, 20000)), "en", "s0", 1), (n + 4, "same row twice", "en", "s0", 1), (n + 4, "same row twice", "en", "s0", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
