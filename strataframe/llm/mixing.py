"""Mixing sources to target weights by a low-discrepancy schedule [DataFrame functions only].

Every source's documents are shuffled by a keyed hash and laid end to end, again and again, as a stream of words that is
cut into blocks of equal size. Points of the golden-ratio sequence, mapped through the cumulative targets, say which
source each slot of the mixture takes its next block from: the k-th slot of a source takes its k-th block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_per_id, settle, words

GOLDEN = 0.6180339887498949
#: Hash buckets of a source's shuffle order, and cells of the unit interval; both spread a source over many tasks.
BUCKETS, CELLS = 4096, 1024
SLOTS_A_CHUNK = 65536


def _key(source: str) -> Column:
    """A name of the source that is never null and equal for equal sources alone."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``skey, source_size, weight, target`` for rows ``skey, source, source_size``. Weights go round in code point
    order, null last; targets share the sum of all sizes by weight and stop at ``most`` times a source's size."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    got = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    got = got.withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    w = Window.orderBy("_ratio", "skey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = got.withColumn("_pos", F.row_number().over(w))
    left = F.sum("source_size").over(whole) - (F.sum("_cap").over(w) - F.col("_cap"))
    heft = F.sum("_w").over(whole) - (F.sum("_w").over(w) - F.col("_w"))
    got = got.withColumn("_level", left.cast("double") / heft.cast("double"))
    got = got.withColumn("_first", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_pos", "_level"))).over(whole))
    return got.select("skey", "source", "source_size", F.col("_w").alias("weight"), F.when(F.col("_pos") < F.col("_first._pos"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_first._level")).alias("target"))


def measured(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, source, size, skey, _h, _b``: a settled table of the documents' sizes and shuffle order."""
    sized = one_per_id(docs, key, source, text).select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("bigint").alias("size"))
    sized = sized.withColumn("skey", _key("source")).withColumn("_h", F.md5(F.col("doc_id").cast("string")))
    return settle(sized.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")), "sized")


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents, the sources with their targets, and the mixture: ``slot, source, block, doc_id, epoch, words``,
    one row for each part of a document that a slot takes. A source's last block is cut where its target is met."""
    sized = measured(docs)
    by_bucket = sized.groupBy("skey", "source", "_b").agg(F.sum("size").alias("_n"))
    goals = settle(targets(by_bucket.groupBy("skey", "source").agg(F.sum("_n").alias("source_size")), weights, most), "goals")
    goals = goals.withColumn("_quota", F.floor(F.col("target") + 0.5).cast("bigint")).withColumn("_blocks", F.ceil(F.col("_quota") / block).cast("bigint"))
    before = Window.partitionBy("skey").orderBy("_b")
    offsets = by_bucket.withColumn("_from", F.sum("_n").over(before) - F.col("_n")).join(goals.select("skey", "source_size", "_quota"), "skey").select("skey", "_b", "_from", "source_size", "_quota")

    # Documents on their source's stream; joined by source and bucket, so that one large source is many keys.
    inside = Window.partitionBy("skey", "_b").orderBy("_h", "doc_id")
    placed = sized.filter("size > 0").withColumn("_at", F.sum("size").over(inside) - F.col("size")).join(offsets, ["skey", "_b"]).withColumn("_at", F.col("_at") + F.col("_from"))
    rounds = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("_s", F.col("epoch") * F.col("source_size") + F.col("_at"))
    rounds = rounds.withColumn("_e", F.least(F.col("_s") + F.col("size"), F.col("_quota"))).filter("_s < _e")
    parts = rounds.withColumn("block", F.explode(F.expr(f"sequence(_s div {block}, (_e - 1) div {block})")))
    parts = parts.withColumn("words", F.least(F.col("_e"), (F.col("block") + 1) * block) - F.greatest(F.col("_s"), F.col("block") * block))

    slots = _slots(goals, block)
    mix = parts.join(slots, ["skey", "block"]).select("slot", "source", "block", "doc_id", "epoch", "words")
    return sized, goals, mix


def _slots(goals: DataFrame, block: int) -> DataFrame:
    """``slot, skey, block``: whose block each slot takes, by golden-ratio points through the cumulative targets."""
    spark = goals.sparkSession
    row = goals.agg(F.sum("_blocks"), F.count(F.lit(1))).first()  # two numbers
    n = int((row[0] or 0) + 4 * (row[1] or 0))
    w = Window.orderBy("skey")
    share = F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cum = goals.filter("_blocks > 0").withColumn("_hi", F.sum("target").over(w) / share).withColumn("_lo", F.coalesce(F.lag("_hi").over(w), F.lit(0.0)))
    cum = cum.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1).cast("bigint")))))
    points = spark.range(1, n + 1).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(1.0)).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    hit = points.join(cum, "_cell").filter("_u >= _lo and _u < _hi").select("slot", "skey", "_blocks", F.expr(f"slot div {SLOTS_A_CHUNK}").alias("_k"))
    counts = hit.groupBy("skey", "_k").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("skey").orderBy("_k")) - F.col("_n"))
    ranked = hit.withColumn("_r", F.row_number().over(Window.partitionBy("skey", "_k").orderBy("slot"))).join(counts, ["skey", "_k"]).withColumn("block", F.col("_r") - 1 + F.col("_before")).filter("block < _blocks").select("slot", "skey", "block")
    had = counts.groupBy("skey").agg(F.sum("_n").alias("_n"))
    short = goals.filter("_blocks > 0").join(had, "skey", "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("bigint"))).filter("_n < _blocks")
    late = short.withColumn("block", F.explode(F.expr("sequence(_n, _blocks - 1)"))).select((F.col("block") + n + 1).alias("slot"), "skey", "block")
    return ranked.unionByName(late)


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 256) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    Nulls: a null text has size 0 and a null source is a source of its own, ordered last. Rows without doc_id are no
    documents; of rows that share one the least by source and text stays. Other columns are ignored. A source without
    words has target 0. An empty table gives an empty result. The shuffle depends on doc_id alone, so reruns agree."""
    sized, goals, mix = schedule(docs, weights, most, block)
    taken = mix.groupBy("doc_id").agg(F.sum("words").alias("_t"))
    spread = goals.select("skey", "source_size", "target").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    out = sized.join(spread, ["skey", "_b"]).join(taken, "doc_id", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_t", F.lit(0)).cast("bigint").alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (ARRAY[5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM g),
c AS (SELECT *, row_number() OVER o AS pos,
        CAST(sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size) AS DOUBLE)
          / CAST(sum(w) OVER () - (sum(w) OVER o - w) AS DOUBLE) AS lev,
        CAST(3 * source_size AS DOUBLE) / w AS ratio
      FROM r WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, coalesce('=' || source, '') ROWS UNBOUNDED PRECEDING)),
f AS (SELECT min(pos) AS p, min_by(lev, pos) AS level FROM c WHERE ratio >= lev),
t AS (SELECT source, source_size, CASE WHEN pos < p THEN CAST(3 * source_size AS DOUBLE) ELSE w * level END AS target FROM c, f),
a AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d)
SELECT a.doc_id, CAST(a.size AS BIGINT) AS size, t.source_size, t.target,
  CAST(coalesce((SELECT sum(greatest(0, least(e * t.source_size + a.start + a.size, CAST(floor(t.target + 0.5) AS BIGINT)) - (e * t.source_size + a.start)))
        FROM (VALUES (0), (1), (2)) AS x(e)), 0) AS BIGINT) AS taken
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source
"""
