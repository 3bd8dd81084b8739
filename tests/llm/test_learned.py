"""Operators that learn: base columns and model formulas against brute force, held-out quality on generated text."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import divergence, langid, ngramlm, quality, shared
from util import CLASHES, SCHEMA, WORD, corpus, empty, messy, rows_of, words


# ------------------------------------------------------------------------------------------------------------- hashing
def test_words_and_hashes():
    texts = ["a b  c", "", " x\ty\n", None, "a b c", "é ü", "a"]
    import pyarrow as pa

    w = shared.Words(*shared.text_buffer(pa.array(texts)))
    flat = [x for t in texts for x in WORD.findall(t or "")]
    assert [w.text(i) for i in range(len(w))] == flat and w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = w.hashes().tolist()
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


# ---------------------------------------------------------------------------------------------------------- 2 divergence
def brute_base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_base_columns(spark):
    df = messy(spark, corpus() + ["a b c d e " * 4, "#x *y <z>\n#x *y <z>\n\n", "ünï cödé " * 3])
    got = rows_of(divergence.judge(df, divergence.references(df)))
    want = collections.Counter((r["doc_id"], *brute_base(r["text"])) for r in df.collect())
    keys = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[k] for k in keys) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert divergence.judge(empty(spark), divergence.references(empty(spark))).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rows_of(divergence.judge(df, {})))


def test_divergent_texts_go(spark):
    rnd = random.Random(2)
    common = ["the", "of", "and", "to", "in", "is"]
    clean = [" ".join(rnd.choice(common) if rnd.random() < 0.5 else x for x in words(rnd, 200, 5000)) for _ in range(60)]
    junk = [" ".join(x + "###" for x in words(rnd, 200, 5000)) for _ in range(3)] + [" ".join(x.upper() + "!!" for x in words(rnd, 200, 5000)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(clean + junk)], SCHEMA)
    kept = {r["doc_id"] for r in rows_of(divergence.judge(df, divergence.references(df))) if r["kept"]}
    assert kept == set(range(60))


def brute_verdicts(rows):
    """kept by the rule in plain Python, from texts and languages."""
    lower = lambda w: w.translate({c: c + 32 for c in range(65, 91)})

    def kind(c):
        for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:?'\"()-", "#*$%&|<>")):
            if c in chars:
                return k
        return 6 if ord(c) > 127 else 8 if c == "!" else 7

    def js(p, q):
        part = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y) if a)
        return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))

    classes, common, total = (collections.defaultdict(collections.Counter) for _ in range(3))
    for text, lang in rows:
        if text is not None and lang is not None:
            classes[lang].update(map(kind, text))
            common[lang].update(map(lower, WORD.findall(text)))
    refs = []
    for lang in classes:
        n = sum(common[lang].values())
        if n >= 100:
            ranked = sorted(common[lang].items(), key=lambda x: (-x[1], divergence_key(x[0])))[:40]
            refs.append(([classes[lang][k] / sum(classes[lang].values()) for k in range(9)], [w for w, _ in ranked], [c / n for _, c in ranked] + [1 - sum(c for _, c in ranked) / n]))
    out = []
    for text, _ in rows:
        text = text or ""
        w, per = list(map(lower, WORD.findall(text))), collections.Counter(map(kind, text))
        n, chars = len(w), len(text)
        best = (math.inf, 0, 0)
        for shares, names, cells in refs:
            mine = [w.count(x) / max(n, 1) for x in names]
            a, b = js([per[k] / max(chars, 1) for k in range(9)], shares), js([*mine, (n > 0) * 1 - sum(mine)], cells)
            best = min(best, (a + b, a, b))
        over = refs and (chars >= 150 and best[1] ** 2 > 0.22**2 + 9 / (8 * math.log(2) * chars) or n >= 50 and best[2] ** 2 > 0.25**2 + 41 / (8 * math.log(2) * n))
        out.append(not brute_base(text)[-1] and not over)
    return out


def divergence_key(word):
    w = shared.Words(*shared.text_buffer(__import__("pyarrow").array([word])))
    return int(w.hashes(shared.LOWER).view(np.int64)[0])


def test_verdicts_against_plain_python(spark):
    rnd = random.Random(12)
    frequent = {lang: [f"{lang}{i}" for i in range(60)] for lang in ("en", "de", "xx")}
    rows = []
    for i in range(150):
        lang = rnd.choice(["en", "en", "de", None])
        text = " ".join(rnd.choice(frequent[lang or "en"]) if rnd.random() < 0.6 else x for x in words(rnd, rnd.choice([5, 30, 60, 200]), 3000))
        kind = rnd.random()
        text = text.upper() if kind < 0.1 else "".join(c + rnd.choice(["", "", "#", "!"]) for c in text) if kind < 0.2 else f"{text}. Été, naïve!\n{text[:40]}" if kind < 0.5 else text
        rows.append((text, lang))
    rows += [("xx1 xx2 xx3", "xx"), (None, "en"), ("", None), (" ".join(rnd.choice(frequent["xx"]) for _ in range(80)), "xx")]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in rows_of(divergence.judge(df, divergence.references(df)))}
    want = brute_verdicts(rows)
    assert [got[i] for i in range(len(rows))] == want and 20 < sum(want) < len(rows) - 20


def test_js_distance():
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    assert np.allclose(divergence.js_distance(p, np.array([0.5, 0.5, 0.0])), [0, math.sqrt(0.5 * (math.log2(1 / 0.75) + 0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25)))])
    assert np.allclose(divergence.js_distance(np.array([[1.0, 0]]), np.array([0, 1.0])), 1)


# ----------------------------------------------------------------------------------------------------- 6 language model
def brute_kneser_ney(train, test):
    lower = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    triples = lambda t: zip(["<s>", "<s>", *lower(t)], ["<s>", *lower(t)], [*lower(t), None])
    tri = collections.Counter(x for t in train for x in triples(t))
    uni = collections.Counter()
    for (_, _, w), c in tri.items():
        uni[w] += c
    pair = collections.Counter((v, w) for _, v, w in tri)  # left neighbours
    seen = collections.Counter(w for _, w in pair)
    n, size = sum(uni.values()), len(uni)

    def discounts(counts):
        k = collections.Counter(counts)
        return ngramlm.discounts(np.array([k[i] for i in (1, 2, 3, 4)]))

    d3, d2, d1 = discounts(tri.values()), discounts(c for (v, _), c in pair.items() if v != "<s>"), discounts(seen.values())
    total = sum(seen.values())
    spread = sum(d1[min(c, 3)] for c in seen.values()) / total
    after, middle = collections.defaultdict(list), collections.defaultdict(list)
    for (u, v, _), c in tri.items():
        after[u, v].append(c)
    for (v, _), c in pair.items():
        if v != "<s>":
            middle[v].append(c)

    def step(count, d, counts, lower):
        if not counts:
            return lower
        return max(count - d[min(count, 3)], 0) / sum(counts) + sum(d[min(c, 3)] for c in counts) / sum(counts) * lower

    def score(t):
        out = base = known = m = 0
        for u, v, w in triples(t):
            p = max(seen[w] - d1[min(seen[w], 3)], 0) / total + spread / (size + 1)
            p = step(pair[v, w] if v != "<s>" else 0, d2, middle.get(v), p)
            p = step(tri[u, v, w], d3, after.get((u, v)), p)
            out += math.log10(p)
            base += math.log10((uni[w] + 1) / (n + size + 1))
            known += uni[w] > 0
            m += 1
        return m, known, n, base, out

    return [score(t) for t in test]


@pytest.mark.parametrize("held,wide", [(10**6, False), (50, False), (50, True)])
def test_kneser_ney(spark, monkeypatch, held, wide):
    """Normal; many flushes; ids of 64 bits."""
    monkeypatch.setattr(ngramlm, "HELD", held)
    monkeypatch.setattr(ngramlm, "ROW_PAIRS", 1 if held == 50 else 2000)
    monkeypatch.setattr(ngramlm, "WIDE", 0 if wide else ngramlm.WIDE)
    df = messy(spark, corpus(n=40)).withColumn("held_out", shared.crc_mod("doc_id", 7) == 2)
    rows = df.select("doc_id", "text", "held_out").collect()
    assert {r["held_out"] for r in rows} == {True, False}
    want = collections.defaultdict(list)
    for r, s in zip(rows, brute_kneser_ney([r["text"] for r in rows if not r["held_out"]], [r["text"] for r in rows])):
        want[r["doc_id"]].append(s)
    model = ngramlm.fit(df.where(~F.col("held_out")))
    for r in rows_of(ngramlm.score(df, model)):
        s = want[r["doc_id"]].pop()
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == s[:3]
        assert math.isclose(r["base_score"], s[3], rel_tol=1e-9) and math.isclose(r["score"], s[4], rel_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    """Over all words, the end and an unknown word, after seen and unseen contexts."""
    import pyarrow as pa

    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(["a b a c", "b a", "c c d", "a", "d a b a"])], SCHEMA)
    model = ngramlm.fit(df)
    for history in ("", "a", "a b", "b a", "d d", "zzz a", "zzz zzz", "c zzz"):
        texts = [f"{history} {w}" for w in ("a", "b", "c", "d", "zzz", "")]
        p, _, firsts = model.tokens(shared.Words(*shared.text_buffer(pa.array(texts))))
        assert math.isclose(sum(p[firsts + len(history.split())]), 1, rel_tol=1e-9), history


def test_counts_beyond_a_byte(spark):
    texts = ["x y z"] * 700 + ["x y q"] * 300 + ["y z"] * 5
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    model = ngramlm.fit(df)
    got = {r["doc_id"]: r["score"] for r in rows_of(ngramlm.score(df.withColumn("held_out", F.lit(False)), model))}
    assert np.allclose([got[i] for i in range(len(texts))], [s[4] for s in brute_kneser_ney(texts, texts)])


def test_language_model_of_nothing(spark):
    model = ngramlm.fit(empty(spark))
    df = messy(spark, ["a b"], clash=False).withColumn("held_out", F.lit(True))
    assert all(r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in rows_of(ngramlm.score(df, model)))


# ---------------------------------------------------------------------------------------------------------- 7 languages
def languages(n=120):
    rnd = random.Random(4)
    alphabets = {"aa": ("ba", "be", "bi", "bo"), "bb": ("ka", "ke", "ki", "ko"), "cc": ("çé", "éç", "çà", "àé")}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(alphabets))
        rows.append((i, " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(3, 30))), lang, "s", 0))
    return rows


def test_language_id(spark):
    rows = languages() + [(900, None, "aa", "s", 0), (901, "123 ... !?", "aa", "s", 0), (902, "BABE bibo", None, "s", 0), (None, "kako kiké", None, None, None), (903, "", "aa", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in CLASHES if c not in ("held_out", "score")])
    df = df.withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False)))
    got = {r["doc_id"]: r for r in rows_of(langid.predict(df, langid.fit(df, ~F.col("held_out"))))}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[:120])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "aa", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.fit(df, F.lit(False))
    assert {r["lang_pred"] for r in rows_of(langid.predict(df, none))} == {"und"}


def test_backoff():
    model = langid.Model(["x", "y"], {})
    grams = {"w": ["hello"], 4: ["abcd", " abc"], 3: ["xyz"], 2: ["q "], 1: ["z"]}
    for kind, gs in grams.items():
        h = np.sort(langid.gram_hashes(gs))
        k = len(gs)
        model.tables[kind] = langid.Table(h, np.arange(k + 1) * 2, np.tile([0, 1], k), np.array([-1.0, -2.0, -3.0, -4.0], np.float32)[: 2 * k], np.array([-9.0, -9.0]))
    t = langid.Letters(["hello abcd wxyzw mq zzz uuu"])
    logs, known = model.words(t, np.arange(6), 0, 2)
    assert known.tolist() == [True, True, True, True, True, False]
    assert np.allclose(logs[1], [-2, -3]) and np.allclose(logs[0], [-1, -2])


def brute_language(train, text, langs):
    """The prediction in plain Python: counts of words and grams by language, words first, then longer to shorter grams."""
    import re

    letters = re.compile(r"[^\W\d_]+")
    kinds = {"w": lambda w: [w], **{n: (lambda w, n=n: langid.grams(w, n)) for n in langid.LENGTHS}}
    counts = {k: {x: collections.Counter() for x in langs} for k in kinds}
    for lang, t in train:
        for w in letters.findall((t or "").lower()):
            for k, f in kinds.items():
                counts[k][lang].update(f(w))
    logs = {}
    for k in kinds:
        kept = {x: {g: n for g, n in c.items() if n >= langid.MIN_COUNT} for x, c in counts[k].items()}
        every = {g for c in kept.values() for g in c}
        total = {x: sum(c.values()) + 0.5 * max(len(every), 1) for x, c in kept.items()}
        logs[k] = {g: [math.log((kept[x].get(g, 0) + 0.5) / total[x]) for x in langs] for g in every}
    found = letters.findall((text or "").lower())
    if not found:
        return "und", 0.0
    sums, n = [0.0] * len(langs), 0
    for w in found:
        for k, f in kinds.items():
            known = [logs[k][g] for g in f(w) if g in logs[k]]
            if known:
                sums, n = [s + sum(x[i] for x in known) / len(known) for i, s in enumerate(sums)], n + 1
                break
    sums = [s * min(n, langid.EVIDENCE) / max(n, 1) for s in sums]
    p = [math.exp(s - max(sums)) for s in sums]
    return langs[p.index(max(p))], max(p) / sum(p)


def test_predictions_against_plain_python(spark, monkeypatch):
    """Of seventy languages, in blocks of sixteen."""
    monkeypatch.setattr(langid, "LANG_BLOCK", 16)
    rnd = random.Random(9)
    langs = [f"l{i:02}" for i in range(70)]
    alphabets = {x: rnd.sample("abcdefghijklmnopqrstuvwxyzäöüéñ", 9) for x in langs}
    make = lambda x: " ".join("".join(rnd.choice(alphabets[x]) for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(1, 40)))
    rows = [(i, make(x := rnd.choice(langs)), x) for i in range(400)] + [(400, "12 !", "l00"), (401, None, "l01"), (402, "ЖЖ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.col("doc_id") % 4 == 2)
    got = {r["doc_id"]: r for r in rows_of(langid.predict(df, langid.fit(df, ~F.col("held_out"))))}
    train = [(x, t) for i, t, x in rows if i % 4 != 2 and x is not None and t is not None]
    known = sorted({x for x, _ in train if x})
    for i, t, _ in rows[::9] + rows[-3:]:
        want = brute_language(train, t, known)
        assert got[i]["lang_pred"] == want[0] and abs(got[i]["score"] - want[1]) < 1e-3, i


def test_language_of_messy_tables(spark):
    df = messy(spark).drop("held_out").withColumn("held_out", F.lit(False))
    got = rows_of(langid.predict(df, langid.fit(df, F.lit(True))))
    assert len(got) == df.count() and all(r["lang_pred"] in ("en", "de", "und") for r in got)
    none = empty(spark).withColumn("held_out", F.lit(False))
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0


# ------------------------------------------------------------------------------------------------------------ 9 quality
def test_quality_classifier(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.75
        w = words(rnd, rnd.randrange(15, 80))
        rows.append((i, " ".join(w) if good else " ".join(x + rnd.choice(["###", "***"]) for x in w), "en", "s", 0))
        labels.append((i, int(good), 0))
    df = messy(spark, [], clash=True).select("doc_id", "text", "lang", "source", "n_chars", *CLASHES)
    both = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(0).alias(c) for c in CLASHES]).unionByName(df.where("doc_id is null").withColumn("doc_id", F.lit(None).cast("long")))
    marks = spark.createDataFrame(labels + [(0, None, 0), (None, 1, 1), (1, labels[1][1], 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(both, marks, shared.crc_mod("doc_id", 5) != 0)
    got = {r["doc_id"]: r["score"] for r in rows_of(quality.score(both, model))}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= quality.THRESHOLD) == labels[i][1] for i in held])
    assert right > 0.95 and all(0 <= s <= 1 for s in got.values())
    kept = quality.keep(both, model)
    assert kept.columns == both.columns and abs(kept.count() - sum(x[1] for x in labels)) < 20
    again = {r["doc_id"]: r["score"] for r in rows_of(quality.score(both.repartition(5), quality.fit(both.repartition(3), marks, shared.crc_mod("doc_id", 5) != 0)))}
    assert all(abs(again[k] - got[k]) < 1e-9 for k in got)  # what is left is the order of additions in a matrix product


@pytest.mark.parametrize("marks", [[], [(0, 1, 0)]])
def test_quality_without_both_labels(spark, marks):
    df = messy(spark, ["one two three"], clash=False)
    model = quality.fit(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r["score"] for r in rows_of(quality.score(df, model))} == ({0.5} if not marks else {1.0})


def test_word_vectors_against_plain_python(spark):
    """Of each token the normalised sum of its neighbours' index vectors, over words and shapes within SPAN."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["red", "Red", "blue", "12", "x#", "tall", "green"]) for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    model = quality.fit(df, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"), F.lit(True))
    streams = []
    for t in texts:
        w = shared.Words(*shared.text_buffer(__import__("pyarrow").array([t])))
        streams.append([x.tolist() for x in quality.token_hashes(w)])
    counts = collections.Counter(h for pair in streams for x in pair for h in x)
    kept = sorted(h for h, n in counts.items() if n >= quality.MIN_COUNT)
    assert model.keys.tolist() == kept
    drawn = {h: v / math.sqrt(counts[h]) for h, v in zip(kept, quality.index_vectors(np.array(kept, np.uint64)).astype(float))}
    want = {h: np.zeros(quality.DIM) for h in kept}
    for pair in streams:
        for i in range(len(pair[0])):
            for mine in (0, 1):
                for other in (0, 1):
                    for j in range(max(0, i - quality.SPAN), min(len(pair[0]), i + quality.SPAN + 1)):
                        if (j != i or mine != other) and pair[mine][i] in want and pair[other][j] in drawn:
                            want[pair[mine][i]] += drawn[pair[other][j]]
    for h, v in zip(kept, model.vectors):
        assert np.allclose(v, want[h] / max(np.linalg.norm(want[h]), 1e-9), atol=1e-3)


def test_quality_of_messy_tables(spark):
    df = messy(spark)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.score(df, quality.fit(df, marks, F.lit(True))))
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    none = empty(spark)
    assert quality.score(none, quality.fit(none, marks, F.lit(True))).count() == 0
    assert quality.score(none, quality.fit(none, marks.limit(0), F.lit(True))).count() == 0
