"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a weight and a schedule, a piecewise linear curve over training time 0..1. A source's target is its
weight's share of all words, at most `most_epochs` times its own words; what that cuts off is shared by weight among
the others. Its documents lie in hash order, one
epoch after another, on the axis of its token demand; the integral of its schedule, scaled to the target, is
the demand reached by each time, and inverting it (a quadratic in each segment) turns a document's place on that axis
into its training position. Documents are range-sorted by position.

The running sums within a source go through (source, hash prefix) buckets, about sqrt(rows) of them, so that no
source, however hot, meets in one task: sums of buckets, a prefix sum over the few buckets, then sums within buckets.

Nulls: a null source is a source of its own, after all others; a null text has 0 words and takes none; a null doc_id
sorts by hash of ''. Rows with the same doc_id are separate documents. Sources without words have target 0. An empty
table gives no rows. Other columns of the input are carried only where asked for, in one struct, so names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lathe.llm.common import WORD, materialize, table

#: Knots (time, height) that the sources use in turn: level, falling, rising. Only the shape counts, not the area.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.25), (0.3, 0.75), (1.0, 1.5)))


def segments(schedules: Sequence[Sequence[tuple[float, float]]]):
    """Literal array (by schedule) of arrays of segments: start, height, slope, and the integral before, all over the whole area."""
    out = []
    for knots in schedules:
        area, segs = 0.0, []
        for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False):
            segs.append((t0, h0, (h1 - h0) / (t1 - t0), area))
            area += (h0 + h1) / 2 * (t1 - t0)
        out.append([(t, h / area, m / area, a / area) for t, h, m, a in segs])
    one = lambda s: F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("t", "h", "m", "a"), s, strict=True)))
    return F.array(*(F.array(*map(one, s)) for s in out))


def position(share, segs):
    """The time at which the integral reaches share (0..1): the last segment that begins at or below it, and its quadratic."""
    seg = F.element_at(F.filter(segs, lambda s: s["a"] <= share), -1)
    rest = share - seg["a"]
    return seg["t"] + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (seg["h"] + F.sqrt(F.greatest(seg["h"] * seg["h"] + 2 * seg["m"] * rest, F.lit(0.0)))))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ord, the place of each source by code point, null last: rows are range-sorted, numbered in their partition, and the partitions' sizes are added up (a row a partition)."""
    order = (F.col("source").isNull(), F.col("source"))
    s = materialize(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mixing-sources")
    parts = s.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("earlier"))
    s = s.join(F.broadcast(parts), "part").withColumn("ord", F.col("earlier") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1)
    return s.drop("part", "earlier")


def targets(sources: DataFrame, weights: Sequence[float], most_epochs: int) -> DataFrame:
    """source, ord, source_size, target of each source. Their number isn't bounded, so they are never in one task: the level to which the weights
    rise is found by sums over all sources, with those capped that it passes, until no more are."""
    s = numbered(sources)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("ord") % len(weights) + 1).cast("int")))
    s = materialize(s.withColumn("cap", F.col("source_size") * most_epochs), "mixing-caps")
    level, n_capped = -1.0, -1
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        total, caps, free, n = s.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if n == n_capped or not free:
            break
        level, n_capped = (total - (caps or 0)) / free, n
    share = F.lit(level) * F.col("weight")
    return s.select("source", "ord", "source_size", F.when(F.col("cap") < share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), schedules=SCHEDULES, most_epochs: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each document, range-sorted by its first training position (those without one at the end):
    doc_id, size, source_size, target, taken, epochs (array of struct of position and words), and row (struct of the columns in carry).

    taken is whole epochs plus, for the documents first in hash order, what the target leaves; so a source's taken
    words are its target, rounded to a word.
    """
    spark = docs.sparkSession
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), digest.alias("h"), *([F.struct(*carry).alias("row")] if carry else []))
    base = materialize(base, "mixing")
    digits = max(1, round(math.log(max(1, base.count()), 256)))
    base = base.withColumn("bucket", F.substring("h", 1, digits))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most_epochs)
    sums = sums.withColumn("before", F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("bucket_size"))
    starts = sums.alias("b").join(per_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("b.source").alias("b_source"), F.col("b.bucket").alias("b_bucket"), "before", "ord", "source_size", "target")
    starts = materialize(starts, "mixing-starts")
    joined = base.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    within = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = joined.withColumn("before", F.col("before") + F.sum("size").over(within) - F.col("size"))
    words = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most_epochs)
    placed = placed.withColumn("words", words).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0))
    left = F.col("words") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    placed = placed.withColumn("part", part).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    segs = F.element_at(segments(schedules), (F.col("ord") % len(schedules) + 1).cast("int"))
    placed = placed.withColumn("segs", segs)
    epoch = lambda e: F.struct(position((e * F.col("source_size") + F.col("before")) / F.col("words"), F.col("segs")).alias("position"), F.when(e < F.col("whole"), F.col("size")).otherwise(F.col("part")).alias("words"))
    n = (F.col("whole") + (F.col("part") > 0).cast("long")).cast("int")
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("position", T.DoubleType()), T.StructField("words", T.LongType())])))
    placed = placed.withColumn("epochs", F.when((F.col("size") > 0) & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), epoch)).otherwise(empty))
    first = F.coalesce(F.try_element_at("epochs", F.lit(1))["position"], F.lit(2.0))
    out = placed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "epochs", first.alias("first"), *(["row"] if carry else []))
    return out.repartitionByRange("first", "doc_id").sortWithinPartitions("first", "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """Every epoch's copy of every document, range-sorted by training position: doc_id, epoch, position, words (a cut copy has fewer than size)."""
    each = mixed.select("doc_id", "size", F.posexplode("epochs").alias("epoch", "e")).select("doc_id", "size", "epoch", "e.position", "e.words")
    return each.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    position = F.when(F.col("first") < 2, F.round("first", 6))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", position.alias("position"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM d GROUP BY source),
w AS (SELECT *, (ord % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT min_by(level, (cap / weight, ord)) FROM l WHERE level * weight <= cap) AS final FROM l),
t AS (SELECT source, source_size, ord, CASE WHEN cap < coalesce(final, 'inf'::DOUBLE) * weight THEN cap::DOUBLE ELSE coalesce(final, 'inf'::DOUBLE) * weight END AS target FROM f),
p AS (SELECT doc_id, size, source_size, target, ord, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS words,
  (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before, ord % 3 AS schedule FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN ((words // source_size) * size + greatest(0, least(size, words % source_size - before)))::BIGINT ELSE 0 END AS taken, before / greatest(words, 1)::DOUBLE AS share FROM p),
g AS (SELECT *, CASE WHEN schedule = 0 THEN [0, 1, 0, 0]::DOUBLE[]
  WHEN schedule = 1 THEN CASE WHEN share < 0.625e0 THEN [0, 1.5, -1, 0]::DOUBLE[] ELSE [0.5, 1, -1, 0.625]::DOUBLE[] END
  WHEN share < 0.15e0 / 0.9375e0 THEN [0, 0.25e0 / 0.9375e0, 0.5e0 / 0.3e0 / 0.9375e0, 0]::DOUBLE[] ELSE [0.3, 0.75e0 / 0.9375e0, 0.75e0 / 0.7e0 / 0.9375e0, 0.15e0 / 0.9375e0]::DOUBLE[] END AS s FROM k)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(s[1] + CASE WHEN share <= s[4] THEN 0 ELSE 2 * (share - s[4]) / (s[2] + sqrt(greatest(s[2] * s[2] + 2 * s[3] * (share - s[4]), 0))) END, 6) END AS position FROM g
"""
