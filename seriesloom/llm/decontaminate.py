"""Operator 3: benchmark decontamination by template canonicalisation, in DataFrame expressions only.

A text becomes a list of tokens in which numbers, units (after a number) and names carry a type mark. A name is a run of
capitalised words, wherever it stands, as one token: the rule looks at nothing around it, so a passage has the same tokens in any
text. The template hash of WINDOW consecutive tokens sees only the type of a marked token, so a question with other numbers or
names has the same template windows; a window with fewer than MIN_LITERAL literal tokens is hashed with its values, for rows of
numbers would all be alike. An item of SHORTEST to WINDOW - 1 tokens is one window of its own length. Items are also indexed with
a small first letter and in small letters throughout, as they stand within sentences and in texts without or only in capitals.

Windows of all documents are hash-joined with those of the benchmark; what is sent to the tasks is a hash, an item and a place each.
The windows of one passage lie on one diagonal (document position minus item position). A passage has MIN_WINDOWS windows, or all
of a shorter item's, and consistent slots: each benchmark value has one document value, which several may share; where the slots
of a diagonal contradict each other, as many windows must match value by value. Nothing but the hits is shuffled.

Defined cases: a null or empty text matches nothing; a benchmark item of fewer than SHORTEST tokens cannot be matched (it would be
found in clean texts everywhere); items with equal texts are all reported. Repeated rows are each judged and removed alike; a null
doc_id is reported as null; other columns play no part and `clean` returns them untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

WINDOW = 8
SHORTEST = 3
MIN_LITERAL = 4
#: Distinct benchmark windows that a passage must match: WINDOW + MIN_WINDOWS - 1 tokens. A shorter item must match whole.
MIN_WINDOWS = 5
#: A benchmark index of up to so many windows (hash, item and place, about 40 bytes each) is sent to every task, and so are its
#: items' tokens; a larger one is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Rows to be removed whose 8-byte hashes may be sent to every task.
BROADCAST_ROWS = 2_000_000
UNITS = "kg|km|cm|mm|mg|ml|lb|lbs|oz|mph|kmh|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|euros|euro|pounds|meters|metres|miles|feet|inches|liters|litres|grams|percent"
NUMBER, NAME, UNIT, JOINT, NAME_END = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; slots begin with their mark, the words of a name are joined."""
    steps = (
        (r"(?<=\d)[.,](?=\d)", ""),
        (rf"(?<=\d) ?(?=(?i:{UNITS})\b)", " " + UNIT),
        (r"(?<![\p{L}\p{N}\x03])\p{Lu}\p{Ll}\p{L}*", f"{NAME}$0{NAME_END}"),
        (f"{NAME_END} {NAME}", JOINT),
        (r"(?<![\p{L}\p{N}])(?=\d)", NUMBER),
        (r"[^\p{L}\p{N}\x01\x02\x03\x04]+", " "),
    )
    marked = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.translate(text, NUMBER + NAME + UNIT + JOINT + NAME_END, "     "))
    return F.split(F.lower(F.trim(marked)), " ")


def _slot(token: Column) -> Column:
    return F.substring(token, 1, 1) <= UNIT


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashed(token: Column) -> Column:
    """The token's type or text in the upper 60 bits, and in the lower four the number of literal tokens: 0 or 1."""
    return F.when(_slot(token), F.xxhash64(F.substring(token, 1, 1)).bitwiseAND(-16)).otherwise(F.xxhash64(token).bitwiseAND(-16).bitwiseOR(F.lit(1)))


def _after(a: Column, b: Column, k: int) -> Column:
    """Windows of which the first k tokens are a window of a and the rest one of b."""
    joined = F.zip_with(a, F.slice(b, k + 1, F.size(b)), lambda x, y: F.xxhash64(x, y).bitwiseAND(-16).bitwiseOR(x.bitwiseAND(15) + y.bitwiseAND(15)))
    return F.slice(joined, 1, F.greatest(F.size(b) - k, F.lit(0)))


def windows(toks: Column, lengths: list[int]) -> Column:
    """Template hashes of the windows of these lengths, by position, one length after another."""

    def out(h1, h2, h4):
        of = {3: lambda: _after(h2, h1, 2), 4: lambda: h4, 5: lambda: _after(h4, h1, 4), 6: lambda: _after(h4, h2, 4), 7: lambda: _after(_after(h4, h2, 4), h1, 6), 8: lambda: _after(h4, h4, 4)}
        return F.concat(*[of[n]() for n in lengths])

    return _let(F.transform(toks, _hashed), lambda h1: _let(_after(h1, h1, 1), lambda h2: _let(_after(h2, h2, 2), lambda h4: out(h1, h2, h4))))


def _windowed(df: DataFrame, keys: list[Column], lengths: list[int]) -> DataFrame:
    """keys, toks and each window's length, place p and hash th."""
    rows = df.select(*keys, tokens(F.col("text")).alias("toks")).withColumn("w", windows(F.col("toks"), lengths))
    names = [c for c in rows.columns if c != "w"]
    rows = rows.select(*names, F.posexplode_outer("w").alias("pos", "t"))  # outer: for an inner one Spark would infer a filter and compute w twice
    length, p, start = F.lit(lengths[-1]), F.col("pos"), F.lit(0)
    places = []
    for n in lengths:
        many = F.greatest(F.size("toks") - (n - 1), F.lit(0))
        places.append((n, start, start + many))
        start = start + many
    for n, low, high in reversed(places):
        length, p = F.when(F.col("pos") < high, F.lit(n)).otherwise(length), F.when(F.col("pos") < high, F.col("pos") - low).otherwise(p)
    rows = rows.where(F.col("t").isNotNull()).withColumn("length", length).withColumn("p", p)
    exact = F.xxhash64(F.slice("toks", F.col("p") + 1, F.col("length")))
    return rows.select(*names, "length", "p", F.when(F.col("t").bitwiseAND(15) >= MIN_LITERAL, F.col("t")).otherwise(exact).alias("th"))


def _forms(bench: DataFrame) -> DataFrame:
    """(item_id, form, text): each item as it is, with a small first letter, and in small letters; equal forms once."""
    text = F.col("text")
    forms = F.array_distinct(F.array(text, F.concat(F.lower(F.substring(text, 1, 1)), F.expr("substring(text, 2)")), F.lower(text)))
    return bench.where(text.isNotNull()).select("item_id", F.explode(forms).alias("text")).withColumn("form", F.xxhash64("item_id", "text"))


def hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, n_windows, n_slots, verbatim): the consistent passages, the longest of each document and item."""
    forms = _forms(bench)
    items = forms.select("item_id", "form", tokens(F.col("text")).alias("item_toks")).where(F.size("item_toks") >= SHORTEST)
    short = sorted(r[0] for r in items.select(F.size("item_toks")).where(F.size("item_toks") < WINDOW).distinct().collect())  # WINDOW - SHORTEST at most
    index = _windowed(forms, [F.col("form")], [*short, WINDOW]).where(F.col("length") == F.least(F.size("toks"), F.lit(WINDOW))).select("th", "form", F.col("p").alias("q")).distinct()
    small = index.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    items = items.withColumn("need", F.least(F.lit(MIN_WINDOWS), F.greatest(F.size("item_toks") - (WINDOW - 1), F.lit(1)))).dropDuplicates(["form"])
    found = _windowed(docs.where(F.col("text").isNotNull()), [F.col("doc_id"), F.xxhash64("doc_id", "text").alias("key")], [*short, WINDOW])
    found = found.join(F.broadcast(index) if small else index, "th")
    found = found.select("doc_id", "key", "form", "q", (F.col("p") - F.col("q")).alias("diag"), F.slice("toks", F.col("p") + 1, F.col("length")).alias("own"))
    found = found.join(F.broadcast(items) if small else items, "form")
    pairs = F.filter(F.zip_with(F.slice("item_toks", F.col("q") + 1, F.size("own")), "own", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: _slot(x["a"]))
    found = found.select("doc_id", "key", "item_id", "form", "need", "diag", "q", pairs.alias("slots"))
    found = found.withColumn("same", F.when(~F.exists("slots", lambda x: x["a"] != x["b"]), F.col("q")))
    passages = found.groupBy("doc_id", "key", "item_id", "form", "need", "diag").agg(F.size(F.collect_set("q")).alias("n_windows"), F.size(F.collect_set("same")).alias("n_same"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["a"])))
    passages = passages.where((F.col("n_windows") >= F.col("need")) & (consistent | (F.col("n_same") >= F.col("need"))))
    verbatim = ~F.exists("slots", lambda x: x["a"] != x["b"])
    return passages.groupBy("doc_id", "key", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max(F.size("slots")).alias("n_slots"), F.max(verbatim).alias("verbatim"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, every column as it was."""
    bad = table(hits(docs, bench).select(F.col("key").alias("bad")).distinct(), "leaks")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    sent = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return own.join(sent, own["key"] == bad["bad"], "left_anti").select("row.*")


def op3_decontaminate_templates(spark, sf_dir: str) -> DataFrame:
    from .shared import read_documents

    found = hits(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.max("verbatim").alias("verbatim"))
