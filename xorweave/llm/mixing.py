"""Mixing sources to target weights, by Efraimidis-Spirakis sampling; DataFrame functions only.

Every document gets an exponential key whose rate is its quality weight. Within a source,
documents in key order are taken until their sizes reach the source's token budget. Budgets
above a source's size first take whole epochs; the fraction that is left is sampled.

The prefix sums need no global sort: keys are cut into ranges, range totals are summed, and only the
one range per source in which the budget ends is sorted, once it is cut down to a few thousand documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored, table

#: Marks that prose seldom holds; their share lowers a document's weight.
MARKS = "|#$%&*!=<>{}[]^~_+\\@"
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of characters that aren't MARKS, cubed (null or empty: 1)."""
    n = F.length(text)
    kept = F.length(F.translate(text, MARKS, ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.pow(kept / F.when(n > 0, n), F.lit(3.0)), F.lit(1.0)))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight; u in (0, 1) comes from md5 of the id, so that reruns agree."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|" + seed))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    return -F.log(u) / weight


def source_plan(docs: DataFrame, weights: tuple, share: float, max_epochs: int) -> DataFrame:
    """One row per source: s_source, source_size, n_docs, target, epochs, rest.

    ``docs`` has s_source and size. Targets are the fixed point of resharing by weight what lies
    above the caps: sources in order of cap / weight fill first.
    """
    sums = docs.groupBy("s_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = Window.orderBy(F.col("s_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("s_source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sums.withColumn("w", w)
        .withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("w_left"))
        .withColumn("nth", F.row_number().over(by_fill))
        .withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("stop", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("nth"))).over(every))
        .withColumn("target", F.least("cap", F.coalesce(F.col("stop") * F.col("w"), F.col("cap"))))
    )
    return rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).select(
        "s_source", "source_size", "n_docs", F.round("target", 6).alias("target"), "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")
    )


def end_ranges(base: DataFrame, plan: DataFrame, range_docs: int) -> DataFrame:
    """(e_source, lo, hi, end_before, n): per source the least and greatest key of the range in which
    the budget ends, the sizes before it, and its documents.

    Such a range is cut by key again until it holds ``range_docs`` documents at most, or one key only.
    """

    def holding(placed: DataFrame) -> DataFrame:
        totals = placed.groupBy("s_source", "bucket").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.first("start").alias("start"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
        along = Window.partitionBy("s_source").orderBy("bucket")
        found = totals.withColumn("upto", F.col("start") + F.sum("sum").over(along)).withColumn("end_before", F.col("upto") - F.col("sum")).filter((F.col("end_before") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        return stored(found.select(F.col("s_source").alias("e_source"), "lo", "hi", "end_before", "n", F.col("rest").alias("e_rest")), "ends")

    # 1 - exp(-key) rises with the key and spreads documents of weight 1 over the ranges
    ranged = plan.select(F.col("s_source").alias("p_source"), "rest", F.lit(0).cast("long").alias("start"), F.ceil(F.col("n_docs") / range_docs).alias("n_ranges"))
    bucket = F.least(F.col("n_ranges") - 1, F.floor((1 - F.exp(-F.col("key"))) * F.col("n_ranges")))
    ends = holding(base.join(small(ranged, 10_000), F.col("s_source").eqNullSafe(F.col("p_source"))).withColumn("bucket", bucket))
    wide = (F.col("n") > range_docs) & (F.col("lo") < F.col("hi"))
    while not (large := ends.filter(wide)).isEmpty():
        # the least and the greatest key fall into different parts, so that each round cuts off some
        cuts = F.ceil(2 * F.col("n") / range_docs)
        part = F.least(cuts - 1, F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cuts))
        inside = base.join(small(large, 10_000), F.col("s_source").eqNullSafe(F.col("e_source")) & F.col("key").between(F.col("lo"), F.col("hi")))
        inside = inside.select("s_source", "size", "key", F.col("e_rest").alias("rest"), F.col("end_before").alias("start"), part.alias("bucket"))
        ends = stored(ends.filter(~wide).unionByName(holding(inside)), "ends")
    return ends.drop("e_rest")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = SEED, range_docs: int = 4096
) -> DataFrame:
    """Per row of ``docs``: its id, size, source_size, target, taken, epochs.

    A null or empty text has size 0 and is taken 0 times its size; null sources form one source,
    the last; rows that repeat an id share a key and are ordered by size; an empty table gives no
    rows. Other columns are ignored. Sums of sources (one row each) pass through one task.
    """
    text = F.col(text_col)
    base = stored(
        docs.select(F.col(id_col).alias("d_id"), F.col(source_col).alias("s_source"), n_words(text).alias("size"), sampling_key(F.col(id_col), quality_weight(text), seed).alias("key")), "mix"
    )
    plan = stored(source_plan(base, weights, share, max_epochs), "plan")
    ends = end_ranges(base, plan, range_docs)
    planned = base.join(small(plan.withColumnRenamed("s_source", "p_source"), 10_000), F.col("s_source").eqNullSafe(F.col("p_source")))
    marked = planned.join(small(ends, 10_000), F.col("s_source").eqNullSafe(F.col("e_source")), "left")
    at_end = F.coalesce(F.col("key").between(F.col("lo"), F.col("hi")), F.lit(False))
    in_order = Window.partitionBy("s_source").orderBy("key", "d_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = marked.filter(at_end).withColumn("here", F.col("end_before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    last = last.withColumn("extra", (F.col("here") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("here")
    rest = marked.filter(~at_end).withColumn("extra", F.coalesce((F.col("key") < F.col("lo")).cast("long"), F.lit(0)))
    return rest.unionByName(last).select(
        F.col("d_id").alias(id_col), "size", "source_size", "target", ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken"), (F.col("epochs") + F.col("extra")).alias("copies")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken. Rows that repeat an id are
    taken alike, as often as the one taken most; so are rows with a null id."""
    copies = mix(docs).groupBy(F.col("doc_id").alias("m_id")).agg(F.max("copies").alias("m_copies")).filter("m_copies > 0")
    repeated = docs.join(copies, docs["doc_id"].eqNullSafe(copies["m_id"])).withColumn("m_nth", F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    greatest(0.05, coalesce(power(CAST(length(translate(text, '|#$%&*!=<>{}[]^~_+\@', '')) AS DOUBLE) / nullif(length(text), 0), 3.0), 1.0)) AS wq,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix-1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / wq AS key FROM base),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM keyed GROUP BY source),
filled AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap, row_number() OVER f AS nth,
    ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum((2 * source_size)::DOUBLE) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / ((sum(w) OVER ()) - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sums WINDOW f AS (ORDER BY (2 * source_size)::DOUBLE / w, source ASC NULLS LAST)),
aimed AS (
  SELECT *, least(cap, coalesce((SELECT arg_min(level, nth) FROM filled WHERE level * w <= cap) * w, cap)) AS goal FROM filled),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(goal / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aimed)
SELECT doc_id, size, source_size, round(goal, 6) AS target,
  CAST((epochs + CASE WHEN coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 <= goal - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
"""
