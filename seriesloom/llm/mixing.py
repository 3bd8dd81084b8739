"""Operator 10: mixing sources to target weights along a time-varying curriculum.

Everything is DataFrame expressions. Three small aggregates drive the plan: words per source, words per (source, hash
bucket), and the water-filled targets. A document's place in its source's stream is the bucket's offset plus a running sum
inside the bucket, so a source that holds a third of all rows is spread over many windows and no task ever sees a whole source. A
bucket is a prefix of the id's hash, one digit longer for each sixteenfold of rows from BUCKET_ROWS a bucket on, and the rows without
an id, which share a hash, are spread by their text's; neither changes the order. Its training position is the inverse of the source's cumulative demand, the integral of its
piecewise-linear weight schedule; `curriculum` range-sorts the copies by that position.

Defined cases: a null text or one without words has size 0, is never short of its target and takes 0 words; a null source
is a source of its own, ranked last; a null or repeated doc_id is an ordinary row (repeated rows are ordered by their text's
digest, and identical rows are interchangeable); an empty table gives an empty plan; other columns pass through `curriculum`
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Multipliers of a source's weight at equal steps of the training run, by its rank; each is integrated piecewise linearly.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUCKET_DIGITS, BUCKET_ROWS = 3, 50_000
#: The hash of the empty id.
NO_ID = "d41d8cd98f00b204e9800998ecf8427e"
WORDS_PATTERN = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(src, absent, source_size) to the same with weight rank and target: weights applied to share of all words, each target
    at most `most` times its source, the excess reshared. Sorted by cap/weight the capped sources are a prefix, so the level
    that iterated resharing converges to is read off running sums; only the source-level table meets in one task."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("absent", "src")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("ratio") < F.col("level"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(final, F.lit(0.0)) * F.col("weight"))).select("src", "absent", "source_size", "rank", "target")


def position(demand: Column, target: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The moment in [0, 1] at which a source's cumulative demand reaches `demand`: the inverse of the normalised integral."""
    share = F.when(target > 0, F.least(demand / target, F.lit(1.0))).otherwise(F.lit(0.0))
    out = None
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:])]
        total, reached, expr = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for i, (a, b, area) in enumerate(zip(knots, knots[1:], areas)):
            rest = (share * total - reached) / step  # = a u + (b - a) u^2 / 2 for u in [0, 1] of this piece
            slope = b - a
            u = (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))) - a) / slope if slope else rest / (a or 1.0)
            pieces.append((reached + area, (i + u) * step))
            reached += area
        for upto, value in reversed(pieces):
            expr = F.when(share * total <= upto, value).otherwise(expr)
        here = F.least(F.greatest(expr, F.lit(0.0)), F.lit(1.0))
        out = here if out is None else F.when(rank % len(schedules) == k, here).otherwise(out)
    return out


def plan_mix(docs: DataFrame, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, positions (array, one per copy taken), rank;
    with keep also `row`, the whole input row."""
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    rows = docs.select(
        *own,
        F.col("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("absent"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
        F.xxhash64("text").alias("h2"),
    )
    digits, n = BUCKET_DIGITS, docs.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    spread = F.concat(F.lit("1"), F.lpad(F.hex(F.shiftrightunsigned(F.col("h2").bitwiseXOR(F.lit(-(1 << 63))), 56)), 2, "0"))  # in the order of h2
    rows = rows.withColumn("bucket", F.concat(F.substring("h", 1, digits), F.when(F.col("h") < NO_ID, "0").when(F.col("h") > NO_ID, "2").otherwise(spread)))
    buckets = rows.groupBy("src", "absent", "bucket").agg(F.sum("size").alias("bucket_size"))
    w = Window.partitionBy("src", "absent")
    buckets = buckets.select("src", "absent", "bucket", F.coalesce(F.sum("bucket_size").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    goal = targets(rows.groupBy("src", "absent").agg(F.sum("size").alias("source_size")))
    facts = buckets.join(F.broadcast(goal) if _few(goal) else goal, ["src", "absent"])
    inside = Window.partitionBy("src", "absent", "bucket").orderBy("h", "h2", "size")
    placed = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(facts, ["src", "absent", "bucket"]).withColumn("start", (F.col("offset") + F.col("inside")).cast("double"))
    starts = [F.col("start") + e * F.col("source_size") for e in range(int(MOST))]
    copies = sum((F.when((F.col("size") > 0) & (s + F.col("size") / 2 <= F.col("target")), 1).otherwise(0) for s in starts), F.lit(0))
    places = F.array(*[position(s, F.col("target"), F.col("rank")) for s in starts])
    return placed.withColumn("copies", copies).select(
        *(["row"] if keep else []), "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"), F.slice(places, 1, F.col("copies").cast("int")).alias("positions"), "rank",
    )


def _few(goal: DataFrame, most: int = 50_000) -> bool:
    """Whether the source-level table is proven small enough to send to every task; else it is joined by key."""
    return goal.limit(most + 1).count() <= most


def curriculum(docs: DataFrame) -> DataFrame:
    """The mix itself: one row per copy taken, in training order, with the input's columns. Documents without words, which
    cost no words, stay once, at the end."""
    plan = plan_mix(docs, keep=True)
    spots = F.when(F.col("size") == 0, F.array(F.lit(1.0))).otherwise(F.col("positions"))
    out = plan.select("row", F.explode(spots).alias("position"), F.xxhash64("row.doc_id").alias("tie"))
    return out.orderBy("position", "tie").select("row.*")


def op10_mix_curriculum(spark, sf_dir: str) -> DataFrame:
    from .shared import read_documents

    plan = plan_mix(read_documents(spark, sf_dir))
    first = F.try_element_at("positions", F.lit(1))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(first, 9).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') src, source IS NULL absent, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size, md5(coalesce(doc_id::VARCHAR, '')) h, text FROM documents),
s AS (SELECT src, absent, sum(size)::DOUBLE source_size, row_number() OVER (ORDER BY absent, src) - 1 rank FROM d GROUP BY src, absent),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END weight FROM s),
c AS (SELECT *, 2 * source_size cap, 2 * source_size / weight ratio FROM w),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) lev FROM c),
t AS (SELECT *, CASE WHEN ratio < lev THEN cap ELSE coalesce(max(CASE WHEN ratio < lev THEN NULL ELSE lev END) OVER (), 0) * weight END target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, coalesce(sum(d.size) OVER (PARTITION BY d.src, d.absent ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE start FROM d JOIN t USING (src, absent)),
k AS (SELECT *, CASE WHEN size > 0 AND start + size / 2 <= target THEN 1 ELSE 0 END + CASE WHEN size > 0 AND start + source_size + size / 2 <= target THEN 1 ELSE 0 END copies, least(start / target, 1.0) f FROM p),
q AS (SELECT *, CASE rank % 3 WHEN 1 THEN f
  WHEN 0 THEN CASE WHEN f <= 0.625 THEN (sqrt(greatest(2.25 - f * 2, 0)) - 1.5) / -0.5 * 0.5 ELSE (1 + (sqrt(greatest(1 - (f - 0.625) * 2, 0)) - 1) / -0.5) * 0.5 END
  ELSE CASE WHEN f <= 0.375 THEN (sqrt(0.25 + f * 2) - 0.5) / 0.5 * 0.5 ELSE (1 + (sqrt(1 + (f - 0.375) * 2) - 1) / 0.5) * 0.5 END END pos FROM k)
SELECT doc_id, size, source_size::BIGINT source_size, round(target, 6) target, size * copies taken, CASE WHEN copies > 0 THEN round(pos, 9) END "position" FROM q
"""
