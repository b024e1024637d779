"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A document's 60-bit hash of its id decides whether it is taken: below its source's threshold, yes. Thresholds
come from histograms: words by source and hash bucket, the bucket in which the budget ends, then the same
for that bucket alone on the next bits. Nothing is sorted, and for fixed ids budgets are nested: a larger one
takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import cut, fresh, join_small, table

#: Bits of the 60-bit hash used at each level; after the last a bucket is one hash value.
LEVELS = (12, 12, 12, 12, 12)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size -> + target: the share of all words by weight, at most ``most`` times the source's size;
    what is cut off is shared again by weight. The fixed point is min(most * size, level * weight); with sources in
    order of size / weight those at their limit are a prefix, so running sums give the level without a loop.
    One row per source goes through the unpartitioned windows, never one per document."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    rows = rows.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("top"))
    order = Window.orderBy((F.col("top") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("top").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    level = F.when(F.col("full") < F.col("total"), (F.col("total") - F.col("full")) / F.col("open")).otherwise(F.lit(0.0))
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("top"))
    # the level of the first source that stays below its limit holds for all after it
    final = F.min(F.when(F.col("fits"), F.struct((F.col("top") / F.col("weight")).alias("r"), "level"))).over(everything)["level"]
    target = F.least("top", F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def source_key(source: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def thresholds(docs: DataFrame, weights: tuple[int, ...], most: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, source, size, h, k; sources as k, source_size, target, whole, threshold)."""
    base = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            hash60(F.col(id_col)).alias("h"),
        ),
        "mix",
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    base, plan = base.withColumn("k", source_key(F.col("source"))), plan.withColumn("k", source_key(F.col("source")))

    state = plan.select("k", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    used = 0
    for bits in LEVELS:
        used += bits
        shift, above = 60 - used, 60 - used + bits
        here = base if used == bits else join_small(base, state.select("k", "prefix"), ["k"], "inner").where(F.shiftright("h", above) == F.col("prefix"))
        bars = here.groupBy("k", F.shiftright("h", shift).alias("bar")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("k").orderBy("bar")
        bars = bars.withColumn("upto", F.sum("words").over(upto))
        bars = join_small(bars, state.select("k", "left"), ["k"], "inner")
        over = F.when(F.col("upto") > F.col("left"), F.struct("bar", "words"))
        edge = bars.groupBy("k").agg(F.min(over).alias("edge"), F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("spent"))
        rest = F.col("left") - F.coalesce("spent", F.lit(0))
        # the last bucket is one hash value: it is taken if that comes nearer to the budget
        near = F.when(F.lit(used == 60) & (F.col("edge.words") - rest < rest), 1).otherwise(0)
        state = cut(
            state.join(edge, "k", "left").select(
                "k",
                # no edge: all of the bucket fits (or it has no rows); the threshold then lies at the bucket's end
                F.coalesce(F.col("edge.bar") + near, F.when(F.lit(used > bits), F.shiftleft(F.col("prefix") + 1, bits)).otherwise(F.lit(1 << bits))).cast("long").alias("prefix"),
                rest.alias("left"),
            ),
            "mix-level",
        )
    return base, plan.join(state.select("k", F.col("prefix").alias("threshold")), "k").select("k", "source_size", "target", "whole", "threshold")


def copies_of(whole: Column, threshold: Column, h: Column, most: int) -> Column:
    return F.when(whole >= most, F.lit(most)).otherwise(whole + (h < threshold).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target (its source's), copies, taken.

    A document is taken floor(target / source_size) times, and once more if its hash is under its source's
    threshold, so at most ``most`` times. Null texts have size 0. A null source is a source of its own, last
    in order. The document at a threshold is taken if that brings its source nearer to its target. Documents with one id share a hash and are taken or left together. A source without words has target 0
    and no copies. Extra columns are pruned; an empty table gives an empty result. The same rows always give the same mix.
    """
    base, cuts = thresholds(docs, weights, most, id_col, text_col, source_col)
    out = join_small(base, cuts, ["k"], "inner").withColumn("copies", copies_of(F.col("whole"), F.col("threshold"), F.col("h"), most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, as often as ``mix`` takes them. Only the table of sources is joined, so rows are not shuffled."""
    _, cuts = thresholds(docs, weights, most, id_col, text_col, source_col)
    k, whole, threshold, copy = fresh(docs, "k", "whole", "threshold", "copy")
    plan = cuts.select(F.col("k").alias(k), F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    rows = join_small(docs.withColumn(k, source_key(F.col(source_col))), plan, [k], "inner", salt_col=fresh(docs, "salt")[0])
    n = copies_of(F.col(whole), F.col(threshold), hash60(F.col(id_col)), most)
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(True), n.cast("int"))).alias(copy)).drop(copy)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The fixed point by its definition: try each count of sources at their limit.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS r FROM s),
l AS (
  SELECT a.r, (SELECT sum(source_size) FROM s) AS total,
         coalesce((SELECT sum(3.0 * b.source_size) FROM o b WHERE b.r < a.r), 0) AS topped,
         (SELECT sum(b.w) FROM o b WHERE b.r >= a.r) AS open, a.w, a.source_size
  FROM o a),
level AS (
  SELECT (arg_min((total - topped) / open, r)) AS v FROM l
  WHERE topped < total AND (total - topped) / open * w <= 3.0 * source_size),
t AS (
  SELECT source, source_size, least(3.0 * source_size, coalesce((SELECT v FROM level), 'inf'::DOUBLE) * w)::DOUBLE AS target FROM s),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * CASE WHEN whole >= 3 THEN 3 ELSE whole + CASE WHEN upto <= budget OR upto - own <= budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM c
"""
