"""Operators with exact answers against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from seriesloom.llm import decontaminate, jaccard, linededup, mixing, substring, tokenfile
from util import CLASHES, WORD, corpus, empty, messy, rows_of


# ------------------------------------------------------------------------------------------------------- 1 substrings
def brute_removed(texts):
    docs = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in docs for i in range(len(w) - 34))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


PERIODIC = ["a " * 36, "a " * 35, "b c " * 40, "x y z " * 30 + " ".join(f"q{i}" for i in range(50))]


@pytest.mark.parametrize("group,seeds", [(50_000, 10**6), (1, 10**6), (50_000, 0), (1, 0)])
def test_substrings(spark, monkeypatch, group, seeds):
    """Normal, with every seed large, and with the census too large to send."""
    monkeypatch.setattr(substring, "FLUSH", 500 if group > 1 else 100_000)
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "BROADCAST_SEEDS", seeds)
    df = messy(spark, corpus() + PERIODIC)
    want = collections.Counter(brute_removed([r["text"] for r in df.select("text").collect()]))
    out = substring.clean(df)
    assert set(CLASHES) <= set(out.columns)
    assert collections.Counter((r["n_words"], r["n_removed"], r["kept"]) for r in rows_of(out)) == want
    assert substring.clean(empty(spark)).count() == 0


def test_depths():
    """Longest common prefixes against all pairs, within rows that end at different places."""
    rnd = np.random.default_rng(2)
    for size in (1, 2, 30, 200):
        paths = rnd.integers(0, 3, size).astype(np.uint64)
        cuts = np.append(np.sort(rnd.choice(np.arange(1, size), min(size // 5, size - 1), replace=False)), size) if size > 1 else np.array([1])
        left = np.concatenate([np.arange(b - a, 0, -1) for a, b in zip(np.append(0, cuts[:-1]), cuts)])
        rows = [tuple(paths[i : i + left[i]]) for i in range(size)]
        common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        want = [max((common(rows[i], rows[j]) for j in range(size) if j != i), default=0) for i in range(size)]
        assert substring.depths(paths, left).tolist() == want


def test_input_columns_named_like_outputs_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "x", 7), (2, text, "y", 8)], "doc_id long, text string, kept string, n_lines int")
    got = {r["doc_id"]: r for r in rows_of(substring.clean(df))}
    assert (got[1]["kept"], got[1]["kept_"], got[2]["n_lines"], got[2]["n_removed"]) == ("x", "", 8, 40)
    got = {r["doc_id"]: r for r in rows_of(linededup.LineIndex(spark, 2).insert(df).apply(df))}
    assert (got[1]["kept"], got[1]["kept_"], got[2]["n_lines"], got[2]["n_lines_"]) == ("x", "", 8, 1)


def test_periodic_texts(spark):
    """Periods about the number of seeds in a window; each text repeats only itself."""
    texts = [" ".join(f"p{n}r{r}w{i % n}" for i in range(r)) for n in (19, 20, 21) for r in (n + 34, n + 35, 3 * n, 5 * n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows_of(substring.clean(df))}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


# ---------------------------------------------------------------------------------------------------------- 3 templates
BENCH = [
    (1, "A train leaves the old station at 40 km per hour and Maria waits for 15 minutes before she follows it by car to the coast"),
    (2, "the quick brown fox jumps over the lazy dog while nobody in the village pays any attention to the noise it makes"),
    (3, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
    (4, None), (5, "too short"), (6, ""),
]


def test_templates(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    texts = [
        "intro words here. " + BENCH[0][1] + ". and more follows after that",
        "Intro: A train leaves the old station at 75 miles per hour and Julia waits for 20 minutes before she follows it by car to the coast!",
        BENCH[1][1].upper(), "numbers 9 8 7 6 5 4 3 2 1 0 9 8 7 6 5 4 3 2 1", "the quick brown fox jumps over", "a clean text about trains, stations and the coast where Maria waits",
    ]
    df = messy(spark, texts)
    hit = {(r["doc_id"], r["item_id"]): r for r in rows_of(decontaminate.hits(df, bench))}
    assert set(hit) == {(0, 1), (1, 1), (2, 2)}
    assert hit[0, 1]["verbatim"] and not hit[1, 1]["verbatim"] and hit[1, 1]["n_slots"] >= 3
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert decontaminate.hits(empty(spark), bench).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == df.count()


def test_inconsistent_slots_are_no_hit(spark):
    """No part of it is long enough to count as a copy word by word."""
    item = "give 5 apples to Anna and then 5 pears to Berta because 5 guests come for tea"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, other = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "9", 1)
    got = {r["doc_id"] for r in rows_of(decontaminate.hits(messy(spark, [same, other]), bench))}
    assert got == {0}


def test_two_benchmark_values_may_share_a_document_value(spark):
    item = "the farmer puts 5 apples and 7 pears into a basket and carries them home before the rain begins"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("5", "6").replace("7", "6"), item.replace("5", "8").replace("7", "9"), item]
    assert {r["doc_id"] for r in rows_of(decontaminate.hits(messy(spark, texts), bench))} == {0, 1, 2}


def test_short_and_slot_dense_items(spark):
    """Copies of items of any length from SHORTEST on, and of items that are mostly numbers."""
    items = [
        "Why did nobody answer the question today?", "What is 7 times 8?", "add the list 12 45 78 33 21 and 9 then give the sum", "Add 12 kg, 5 kg and 7 kg of sand now",
        "What is the capital of France?", "Name three rivers", "12 15 18 21 24 27 30 33 36 39 42 45 48", "Anna lives in New York and pays 900 dollars rent each month for her small flat",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Someone asked, {x} and then left the room." for x in items] + [x.upper() for x in items] + [x.lower() for x in items]
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.hits(messy(spark, texts), bench))}
    assert {(i, i % len(items)) for i in range(len(texts))} <= got
    other = ["what is the capital of Italy?", "Bob Smith lives in Paris and pays 700 euros rent each month for her small flat", "12 15 18 21 24 27 30 33 99 39 42 45 48", "what is 9 times 4", "Name three lakes"]
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.hits(messy(spark, other), bench))}
    assert got == {(0, 4), (1, 7)}


def test_a_value_changed_in_one_place(spark):
    """The slots contradict each other, but most windows are copied word by word."""
    item = "a shop sells 5 red hats and 5 blue hats on monday and then the owner counts all of the hats that are left in the big wooden box near the door"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in rows_of(decontaminate.hits(messy(spark, [item.replace("5 blue", "9 blue")]), bench))] == [0]


def brute_hits(texts, items):
    """All pairs of a document's and an item's windows, in plain Python."""
    import regex

    def toks(text):
        text = regex.sub("[\x01-\x05]", " ", text)
        for pattern, new in ((r"(?<=\d)[.,](?=\d)", ""), (rf"(?<=\d) ?(?=(?i:{decontaminate.UNITS})\b)", " \x03"), (r"(?<![\p{L}\p{N}\x03])\p{Lu}\p{Ll}\p{L}*", "\x02\\g<0>\x05"), ("\x05 \x02", "\x04"), (r"(?<![\p{L}\p{N}])(?=\d)", "\x01")):
            text = regex.sub(pattern, new, text)
        return regex.sub("[^\\p{L}\\p{N}\x01-\x04]+", " ", text).strip(" ").lower().split(" ")

    def alike(a, b):
        typed = [x[:1] if x[:1] <= "\x03" else x for x in a] == [x[:1] if x[:1] <= "\x03" else x for x in b]
        return a == b or typed and sum(x[:1] > "\x03" for x in a) >= 4

    out = set()
    for d, text in enumerate(texts):
        own = toks(text)
        for i, item in enumerate(items):
            for form in {item, item[:1].lower() + item[1:], item.lower()}:
                want = toks(form)
                n = min(8, len(want))
                diagonals = collections.defaultdict(list)
                for p in range(len(own) - n + 1) if n >= 3 else ():
                    for q in range(len(want) - n + 1):
                        if alike(want[q : q + n], own[p : p + n]):
                            diagonals[p - q].append((want[q : q + n], own[p : p + n]))
                need = min(5, len(want) - n + 1)
                for found in diagonals.values():
                    slots = {(a, b) for x, y in found for a, b in zip(x, y) if a[:1] <= "\x03"}
                    if len(found) >= need and (len(slots) == len({a for a, _ in slots}) or sum(x == y for x, y in found) >= need):
                        out.add((d, i))
    return out


def test_hits_against_all_pairs_of_windows(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    pool = ["the", "box", "of", "red", "hats", "is", "sold", "for", "and", "then", "Anna", "Bob", "New", "York", "Paris", "3", "17", "2.5", "40", "km", "hours", "dollars", "near", "old"]
    pick = lambda n: " ".join(rnd.choice(pool, n))
    items = [pick(int(n)) for n in rnd.integers(2, 24, 25)]
    texts = []
    for _ in range(60):
        item = items[int(rnd.integers(len(items)))].split()
        for _ in range(int(rnd.integers(0, 3))):
            item[int(rnd.integers(len(item)))] = str(rnd.choice(pool))
        texts.append(f"{pick(6)} {' '.join(item)}{rnd.choice(['', ',', '.'])} {pick(5)}")
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_hits(texts, items)
    assert len(want) > 25
    for bound in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        assert {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.hits(df, bench))} == want
        assert {r["doc_id"] for r in rows_of(decontaminate.clean(df, bench))} == set(range(60)) - {d for d, _ in want}


# -------------------------------------------------------------------------------------------------------------- 4 tokens
def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.vocabulary_path())
    odd = ["a  b", "\n\nx y \n z  ", " lead", "tab\tx\t\ty", "nb sp x", "<|endoftext|> hi", " 's it's 'll", "e　f g", "x\x1cy", "   ", "日本語 テキスト", "x1y2 3,000.5 don't"]
    df = messy(spark, corpus(n=12) + odd)
    tokenfile.write_tokens(df, str(tmp_path / "f"), partitions=3)
    got = {}
    for r in rows_of(tokenfile.read_tokens(spark, str(tmp_path / "f"), ids=True)):
        got.setdefault(r["doc_id"], []).append(r)
    start = 0
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        r = next(x for x in got[doc_id] if x["start"] == start)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokenfile.write_tokens(empty(spark), str(tmp_path / "e"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_codec():
    rnd = np.random.default_rng(0)
    for bits in (1, 2, 3, 7, 11, 16, 17, 31, 59, 60, 61, 64):
        for n in (0, 1, 2, 59, 1023, 1024, 1025, 5000):
            ids = rnd.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(64 - bits)
            data = tokenfile.pack(ids)
            assert (tokenfile.unpack(data) == ids).all() and len(tokenfile.unpack(data)) == n
            if n > 1024:
                assert (tokenfile.unpack(data, 1) == ids[1024:2048]).all()
    assert len(tokenfile.pack(np.zeros(6000, np.uint64))) < 6000 / 60 * 8 + 200 + 6 * 4 * 8


# ------------------------------------------------------------------------------------------------------------- 5 Jaccard
def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, min(ids) if ids else None, links[i]))
    return out


@pytest.mark.parametrize("small,cell,ids,dense", [(64, 512, 10**6, 0.6), (2, 4, 0, 0.6), (2, 4, 0, 2.0)])
def test_classes(spark, monkeypatch, small, cell, ids, dense):
    """Normal, and with every bucket split, dense ones too, large leaves dealt over cells and ids joined by shuffle."""
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", 150 * cell)
    monkeypatch.setattr(jaccard, "ROWS", 7)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    df = messy(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = collections.Counter(brute_classes(rows))
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(jaccard.classes(df))) == want
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    groups = {c for d, c, _ in want if c is not None}
    assert kept.where("doc_id is not null").count() == len(groups) and kept.where("doc_id is null").count() == 1
    assert jaccard.classes(empty(spark)).count() == 0


def test_large_buckets_with_the_same_members(spark, monkeypatch):
    """Templates with a unique field of equal length: the buckets of a group all have the same members."""
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "DENSE", 2.0)
    texts = [" ".join([f"g{g}w{i}" for i in range(204)] + [f"g{g}d{d}u{i}" for i in range(16)]) for g in range(60) for d in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(jaccard.classes(df))} == {(i, i - i % 8, 7) for i in range(480)}


def test_runs_repeat_until_the_recall_is_reached(spark, monkeypatch):
    """One pick a run misses many pairs at first; the estimate from the pairs' numbers of runs sees it."""
    rnd, tried = np.random.default_rng(5), []
    monkeypatch.setattr(jaccard, "RUNS", 2)
    monkeypatch.setattr(jaccard, "ROOT_PICKS", 1)
    links = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda own, runs: tried.append(runs) or links(own, runs))
    texts = []
    for g in range(200):
        base = [f"g{g}w{i}" for i in range(60)]
        near = list(base)
        near[int(rnd.integers(10, 50))] = "edit"
        texts += [" ".join(base), " ".join(near)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sum(r["n_links"] for r in rows_of(jaccard.classes(df)))
    assert tried[0] == 2 and len(tried) > 1 and found >= 0.99 * 400


# --------------------------------------------------------------------------------------------------------------- 8 lines
def brute_lines(texts, least):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    df = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or df[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("limit,shard_keys", [(10**6, 10**6), (0, 10**6), (1, 1)])
def test_lines(spark, monkeypatch, limit, shard_keys):
    """Keys sent to the tasks; joined; and the most frequent sent, the others joined, over many shards."""
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard_keys)
    df = messy(spark, corpus() + [f"own line {i}\nTwelve times\nthirteen times" for i in range(12)] + ["thirteen TIMES "])
    texts = [r[0] for r in df.select("text").collect()]
    out = linededup.LineIndex(spark).insert(df).apply(df)
    assert collections.Counter((r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(out)) == brute_lines(texts, 10)
    assert set(CLASHES) - {"kept"} <= set(out.columns)


def test_lines_are_reversible(spark):
    df = messy(spark, clash=False)
    part = df.where("doc_id % 3 = 0")
    rest = [r[0] for r in df.where("doc_id is null or doc_id % 3 <> 0").select("text").collect()]
    index = linededup.LineIndex(spark, 3).insert(df).delete(part)
    other = df.where("doc_id is null or doc_id % 3 <> 0")
    assert collections.Counter((r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(index.apply(other))) == brute_lines(rest, 3)
    back = index.insert(part)
    every = [r[0] for r in df.select("text").collect()]
    assert collections.Counter((r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(back.apply(df))) == brute_lines(every, 3)
    assert linededup.LineIndex(spark).insert(empty(spark)).apply(empty(spark)).count() == 0


def test_a_full_filter_is_built_anew(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARDS", 2)
    first = spark.createDataFrame([(0, "a\nb")], "doc_id long, text string")
    many = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(400))) for i in range(1, 3)], "doc_id long, text string")
    both = first.unionByName(many)
    index = linededup.LineIndex(spark, 1).insert(first).insert(many)
    assert collections.Counter((r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(index.apply(both))) == brute_lines([r[1] for r in both.collect()], 1)


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    f = linededup.built(keys)
    assert all(k in f for k in keys)
    assert sum(hashlib.md5(f"x{i}".encode()).digest() in f for i in range(20000)) < 40
    assert all(f.delete(k) for k in keys[:1500]) and all(k in f for k in keys[1500:]) and f.n == 1500
    assert linededup.CuckooFilter(state=f.to_bytes()).to_bytes() == f.to_bytes()


# ----------------------------------------------------------------------------------------------------------- 10 mixing
def brute_targets(sizes):
    """Reshares the excess until no source is over its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    df = messy(spark)
    plan = rows_of(mixing.plan_mix(df))
    sizes, source = collections.Counter(), {}
    for r in df.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        source[r["doc_id"]] = r["source"]
    want = brute_targets(dict(sizes))
    taken = collections.Counter()
    largest = collections.Counter()
    for r in plan:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["positions"]) == r["copies"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    out = mixing.curriculum(df)
    assert out.columns == df.columns
    again = [(r["doc_id"], r["text"]) for r in mixing.curriculum(df.repartition(7)).collect()]
    assert again == [(r["doc_id"], r["text"]) for r in out.collect()]
    assert mixing.plan_mix(empty(spark)).count() == 0 and mixing.curriculum(empty(spark)).count() == 0


def test_buckets_do_not_change_the_plan(spark, monkeypatch):
    """One bucket beside many, with rows without an id, which are spread by their texts in the same order."""
    rows = [(None if i % 3 else i, f"own text {i} " * (i % 7), "en", f"s{i % 2}", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plans = []
    for digits, least in ((0, 10**6), (3, 10**6), (1, 1)):
        monkeypatch.setattr(mixing, "BUCKET_DIGITS", digits)
        monkeypatch.setattr(mixing, "BUCKET_ROWS", least)
        plans.append(sorted((r["doc_id"] or -1, r["size"], r["taken"], tuple(r["positions"])) for r in mixing.plan_mix(df).collect()))
    assert plans[0] == plans[1] == plans[2]


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for k, knots in enumerate(mixing.SCHEDULES):
        df = spark.range(101).select((F.col("id") / 100.0).alias("d"), mixing.position(F.col("id") / 100.0, F.lit(1.0), F.lit(k)).alias("t"))
        x = np.linspace(0, 1, 20001)
        m = np.interp(x, np.linspace(0, 1, len(knots)), knots)
        cum = np.concatenate([[0], np.cumsum((m[1:] + m[:-1]) / 2)])
        cum /= cum[-1]
        for r in df.collect():
            assert abs(np.interp(r["t"], x, cum) - r["d"]) < 1e-4
