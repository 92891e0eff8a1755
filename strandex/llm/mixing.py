"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed hash of its id. Per source, the words are summed by hash bucket; the
bucket in which the budget ends is found and only that bucket is summed again by the next bits of
the hash, until single hash values are left. A document is then in the mix if its hash lies below
its source's threshold: a filter, no sort. A source whose target exceeds its size takes all of it
once, and a second time what lies below the threshold of the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from strandex.llm.runtime import Tables, settled

#: Bits of the hash that each level looks at; 36 bits in all.
LEVELS = (12, 12, 12)
BITS = sum(LEVELS)
WORD = r"[^\x20\x09-\x0D]+"
#: Source rows broadcast to the documents at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words_in(text):
    """Words of a text, as a long; 0 for null."""
    return F.coalesce(F.size(F.expr(rf"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+', 0)")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size -> also ``target``: share of all sizes by weight, at most ``most`` times the size.

    The level L at which sum(min(weight * L, most * size)) is the whole has a closed form: sources
    stop in the order of most * size / weight, so that running sums over the sources give, for each
    number of stopped ones, the level of the others. One row per source is sorted; no document is.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int")))
    everything = Window.partitionBy()
    stops = Window.orderBy(F.col("_stop") , F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(most)).withColumn("_stop", F.col("_cap") / F.col("_w"))
    ranked = ranked.withColumn("_whole", F.sum("source_size").over(everything) * float(share)).withColumn("_all_w", F.sum("_w").over(everything))
    ranked = ranked.withColumn("_level", (F.col("_whole") - F.coalesce(F.sum("_cap").over(stops), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(stops), F.lit(0.0))))
    # The first source that doesn't stop sets the level for itself and all after it.
    level = F.min(F.when(F.col("_level") < F.col("_stop"), F.struct("_stop", "_level"))).over(everything)
    ranked = ranked.withColumn("_found", level)
    return ranked.select("source", "source_size", F.when(F.col("_found").isNull() | (F.col("_stop") < F.col("_found._stop")), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_found._level"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted).

    ``most`` is at most 2: no document is taken more than twice. Sources get the weights in turn, by
    code point, null last. A null source is a source. Null or empty text: size 0, takes 0. The hash
    is of the id as text (null: of the empty text), so that reruns agree and repeated rows share
    their fate. An empty table gives an empty table. Columns of ``docs`` with the new names are replaced;
    others may have any name.
    """
    if not 0 < most <= 2:
        raise ValueError("most must be above 0 and at most 2")
    new = ("size", "source_size", "target", "taken")
    work = Tables(docs.sparkSession, "mixing")
    keys = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    sized = docs.select(F.col(source_col).alias("source"), keys.alias("key"), words_in(f"`{text_col}`").alias("size"))
    # One pass over the texts; from here on rows hold a source, a hash and a size.
    fine = work.write("sized", sized.groupBy("source", "key").agg(F.sum("size").alias("size")))
    totals = targets(fine.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # Words still to take by threshold: of the target, or of what it has beyond one whole copy.
    open_ = totals.withColumn("copies", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    totals = work.write("totals", open_.withColumn("prefix", F.lit(0).cast("long")))
    few = totals.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda x: x)
    found, left = totals, BITS
    for bits in LEVELS:
        left -= bits
        at = found.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
        inside = fine.join(small(at), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("key", left + bits) == F.col("_p")))
        buckets = inside.groupBy("source", F.shiftright("key", left).alias("bucket")).agg(F.sum("size").alias("words"))
        joined = small(found).join(buckets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        joined = joined.withColumn("_before", before).withColumn("_words", F.coalesce("words", F.lit(0)))
        if left:  # the last bucket that begins below the budget holds the threshold
            at_end = F.max(F.when(F.col("_before") < F.col("rest"), F.struct("bucket", "_before")))
            found = joined.groupBy("source", "source_size", "target", "copies", "rest", "prefix").agg(at_end.alias("_at"))
            found = found.select("source", "source_size", "target", "copies", (F.col("rest") - F.coalesce(F.col("_at._before"), F.lit(0))).alias("rest"), F.coalesce(F.col("_at.bucket"), F.lit(0)).alias("prefix"))
        else:  # single hash values: one is in if at least half of it fits
            last = F.max(F.when(2 * F.col("_before") + F.col("_words") <= 2 * F.col("rest"), F.col("bucket")))
            below = F.shiftleft(F.col("prefix"), bits) - 1
            found = joined.groupBy("source", "source_size", "target", "copies", "rest", "prefix").agg(last.alias("_last")).select("source", "source_size", "target", "copies", F.coalesce("_last", below).alias("last_key"))
        found = work.write(f"found{left}", found)
    work.drop("sized")
    found = small(found.select(F.col("source").alias("_s"), F.col("source_size").alias("_size"), F.col("target").alias("_target"), F.col("copies").alias("_copies"), F.col("last_key").alias("_last")))
    names = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{source_col}`").alias("of"), words_in(f"`{text_col}`").alias("size"), keys.alias("key"))
    out = rows.join(found, F.col("of").eqNullSafe(F.col("_s")), "left")
    copies = F.col("_copies") + F.when(F.col("key") <= F.col("_last"), 1).otherwise(0)
    return settled(out.select(*[F.col("row").getField(c).alias(c) for c in names], "size", F.col("_size").cast("long").alias("source_size"), F.coalesce(F.col("_target"), F.lit(0.0)).cast("double").alias("target"), (copies * F.col("size")).cast("long").alias("taken")))


SQL = r"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 9))::BIGINT AS k,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
c AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS stop FROM r),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM c
      WINDOW b AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, stop) AS level, min(stop) AS stop FROM l WHERE level < stop),
t AS (SELECT l.source, source_size, CASE WHEN f.stop IS NULL OR l.stop < f.stop THEN cap ELSE least(cap, w * f.level) END AS target FROM l, f),
v AS (SELECT source, k, sum(size) AS words FROM d GROUP BY source, k),
b AS (SELECT source, k, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
y AS (SELECT b.source, k, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS copies,
        2 * before + words <= 2 * (target - CASE WHEN target >= source_size THEN source_size ELSE 0 END) AS more
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * (y.copies + y.more::INT))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.k = y.k
"""
