"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

The sizes of all documents are summed by source and hash bucket; the bucket in which a source's budget ends is split
again by the next bits of the hash, until the boundary is one hash value. What a document contributes then follows from
comparing its hash with its source's threshold: no document is ever sorted, and a larger budget takes a superset.

Defined cases: null text has size 0; null source is a source of its own, last in the order of weights; rows with the same
doc_id have the same hash and are taken alike; an empty table gives no rows; a source whose size is 0 has target 0.
Other columns of the input are ignored unless named in `carry`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, stage

#: Bits of the hash that one level of histograms resolves, and the number of levels.
BITS, LEVELS = 12, 4
#: Most that a source may give, as a multiple of its size.
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column) -> Column:
    """48 bits of the md5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target of each source from (source, source_size), one row a source.

    Weights 1, 2, 3, 1, ... go by the order of the sources' code points, null last. A source is held at MOST times its
    size when its share would be more, and what it leaves is shared by weight among the others until none is above: with
    the sources in the order of cap over weight, the held ones are a prefix of that order, so one running sum finds them; rest over free only falls after that prefix, so its largest value is the level.
    The two windows run over one row per source and not over documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", MOST * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("free", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("held", F.col("rest") * F.col("weight") >= F.col("cap") * F.col("free"))
    )
    level = F.max(F.when(~F.col("held"), F.col("rest") / F.col("free"))).over(everything)
    return ranked.withColumn("level", level).select("source", "source_size", F.when(F.col("held"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, rounds, threshold, part): documents with h < threshold are taken once more than
    rounds, and of those with h = threshold that part more, which is what the budget still owes.

    Level by level, only the rows of the bucket in which the budget ends are summed again.
    """
    state = targets.select(
        F.col("source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(MOST))).otherwise(0).cast("int").alias("rounds"),
        F.lit(0).cast("long").alias("prefix"),
    ).withColumn("budget", F.greatest(F.col("target") - F.col("rounds") * F.col("source_size"), F.lit(0.0)))
    for level in range(LEVELS):
        rows, state = slim.alias("d"), state.alias("s")
        above = BITS * (LEVELS - level)
        same = F.col("d.source").eqNullSafe(F.col("s.source"))
        if level:
            same &= F.shiftrightunsigned(F.col("d.h"), above) == F.shiftrightunsigned(F.col("s.prefix"), above)
        if level:
            kept = rows.join(state, same, "left_semi")
        else:
            kept = rows
        sums = kept.groupBy(F.col("d.source").alias("k"), F.shiftrightunsigned(F.col("d.h"), above - BITS).alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("n").over(run)).alias("c")
        fits = F.col("c.upto") <= F.col("s.budget")
        state = (
            state.join(sums, F.col("s.source").eqNullSafe(F.col("c.k")), "left")
            .groupBy(F.col("s.source").alias("source"), "source_size", "target", "rounds", "prefix", "budget")
            .agg(F.max(F.when(fits, F.col("c.upto"))).alias("used"), F.max(F.when(fits, F.col("c.b"))).alias("top"), F.min(F.when(~fits, F.struct("c.b", "c.n"))).alias("over"))
        )
        nothing = F.col("over").isNull()
        width = 1 << (above - BITS)
        state = state.select(
            "source",
            "source_size",
            "target",
            "rounds",
            # no bucket is left over: all hashes below the end of the last one fit
            F.when(nothing, F.coalesce((F.col("top") + 1) * width, F.col("prefix"))).otherwise(F.col("over.b") * width).alias("prefix"),
            F.when(nothing, F.lit(0.0)).otherwise(F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"),
            F.col("over.n").alias("edge_size"),
        )
    return state.select("source", "source_size", "target", "rounds", F.col("prefix").alias("threshold"), F.when(F.col("edge_size") > 0, F.col("budget") / F.col("edge_size")).otherwise(0.0).alias("part"))


def mix_sources(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken, and the columns named in carry.

    taken is size times a number of repeats from 0 to 3, but for the document at the boundary hash of its source, of which
    only the words still owed are taken; so the sum over a source misses its target by less than a word for each document
    at that hash (one, unless ids repeat). Counts are summed by (source, bucket) before they are exchanged, so a
    source with most of the rows is one row per bucket and task.
    """
    slim = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unit_hash(F.col("doc_id")).alias("h"), *[F.col(c).alias(f"carry_{c}") for c in carry or []]), "mix")
    core = slim.select("source", "size", "h")
    sizes = core.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = stage(thresholds(core, source_targets(sizes)), "mix-limits").alias("t")
    # one row a source: sources are few against documents, and the join is broadcast when their measured size allows it
    return slim.alias("d").join(limits, F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id",
        "d.size",
        "t.source_size",
        "t.target",
        (F.col("d.size") * (F.col("t.rounds") + (F.col("d.h") < F.col("t.threshold")).cast("int")) + F.when(F.col("d.h") == F.col("t.threshold"), F.floor(F.col("d.size") * F.col("t.part"))).otherwise(0)).cast("long").alias("taken"),
        *[F.col(f"d.carry_{c}").alias(c) for c in carry or []],
    )


#: The same mix in DuckDB: the hash order is sorted outright there.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0 * CAST(source_size AS DOUBLE) AS cap FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE)
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM w),
l AS (SELECT *, max(CASE WHEN NOT rest * weight >= cap * free THEN rest / free END) OVER () AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN rest * weight >= cap * free THEN cap ELSE weight * level END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS INT), 3) ELSE 0 END AS rounds FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
m AS (SELECT b.source, min(c.h) AS edge, arg_min(CASE WHEN c.n > 0 THEN (greatest(b.target - b.rounds * b.source_size, 0.0) - (c.upto - c.n)) / c.n ELSE 0.0 END, c.h) AS part
      FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source
      WHERE c.upto > greatest(b.target - b.rounds * b.source_size, 0.0) GROUP BY b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.rounds + CASE WHEN m.edge IS NULL OR d.h < m.edge THEN 1 ELSE 0 END)
         + CASE WHEN d.h = m.edge THEN CAST(floor(d.size * m.part) AS BIGINT) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM b.source
"""
