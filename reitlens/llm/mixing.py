"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Targets are filled like water: every source gets its weight's share, sources
that would exceed their cap stay at it, and the rest is shared again.  Inside a
source whole copies are taken of every document and the remainder is picked by
a hash threshold: words are summed by source and hash bucket, the bucket that
crosses the remainder is refined by the next hash bits, and all documents below
the final threshold are taken once more.  Nothing is sorted, the same document
always has the same hash, and a smaller budget takes a subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reitlens.llm.common import stored, word_count

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words.
BUDGET = 1.5
#: No source gives more than this many times its words.
MOST = 2
#: Hash bits per document and per histogram level.
BITS, STEP = 60, 12


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id and the text's own MD5 (nulls: empty strings), so that rows of one id or without an id spread."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight with caps, the excess shared again.

    Sources are numbered in code point order through range partitions that are
    stored first, so that no task holds all of them; each round of sharing is
    one aggregation to three numbers and ends when no source is above its cap.
    """
    spark = sources.sparkSession
    order = [F.col("source").asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sources.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").count()  # one row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    ranged = ranged.join(F.broadcast(start), "part")
    index = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (index % len(weights) + 1).cast("int"))
    s = ranged.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    wanted = float(budget) * total
    share = None  # of one unit of weight
    while True:
        capped = F.lit(False) if share is None else F.col("w") * F.lit(share) > F.col("cap")
        got = s.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)).alias("c"), F.sum(F.when(capped, 0).otherwise(F.col("w"))).alias("w"), F.sum(capped.cast("long")).alias("n")).first()
        if not got["w"]:
            break
        now = (wanted - float(got["c"])) / float(got["w"])
        if now == share:
            break
        share = now
    if share is None:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    target = F.when(F.col("w") * F.lit(share) > F.col("cap"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.lit(share))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, copies, last): whole copies of every document, and the largest hash that is taken once more."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    open_ = stored(sources.withColumn("copies", full)
                   .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
                   .select("source", "copies", "rest", F.lit(0.0).alias("under"), F.lit(0).cast("long").alias("prefix")), "mix-open")
    done = None
    for level in range(1, BITS // STEP + 1):
        shift = BITS - STEP * level
        inside = sizes
        if level > 1:
            b = open_.select(F.col("source").alias("b_source"), F.col("prefix").alias("b_prefix"))
            inside = sizes.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("hash", shift + STEP) == F.col("b_prefix"))).select("source", "size", "hash")
        hist = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        # at most 4,096 buckets a source and level
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        o = open_.select(F.col("source").alias("o_source"), "copies", "rest", "under")
        cum = hist.withColumn("upto", F.sum("words").over(w)).join(o, F.col("source").eqNullSafe(F.col("o_source"))).withColumn("upto", F.col("upto") + F.col("under"))
        crossing = cum.where("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto", "lo", "hi", "copies", "rest"), "bucket").alias("x"))
        found = stored(crossing.select("source", "x.*"), "mix-level")
        # one hash left in the bucket: it is taken if that comes nearer to the rest
        single = found.where("lo = hi").select("source", "copies", F.when(F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("words")), F.col("hi")).otherwise(F.col("hi") - 1).alias("last"))
        whole = (open_.join(found.select(F.col("source").alias("f_source")), F.col("source").eqNullSafe(F.col("f_source")), "left_anti")
                 .select("source", "copies", F.lit((1 << BITS) - 1).cast("long").alias("last")) if level == 1 else None)
        for part in (single, whole):
            if part is not None:
                done = part if done is None else done.unionByName(part)
        open_ = found.where("lo < hi").select("source", "copies", "rest", (F.col("upto") - F.col("words")).cast("double").alias("under"), F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    return done


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``; words taken = size * copies.

    A null text has size 0, a null source is a source of its own (the last).
    Rows that agree in id and text share a hash and are taken alike; other rows
    of one id, or without an id, are told apart by their text.  Documents without
    words are taken with the others of their hash range.  If all sizes are 0 so
    are the targets, and an empty table gives an empty result.
    """
    sizes = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                               document_hash(F.col(doc_id), F.col(text)).alias("hash")), "mix-sizes")
    sources = stored(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most), "mix-targets")
    last = thresholds(sizes, sources)
    plan = sources.join(last.select(F.col("source").alias("t_source"), "copies", "last"), F.col("source").eqNullSafe(F.col("t_source")))
    plan = stored(plan.select(F.col("source").alias("p_source"), "source_size", "target", "copies", "last"), "mix-plan")
    return (sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
            .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + (F.col("hash") <= F.col("last")).cast("long")).alias("copies")))
