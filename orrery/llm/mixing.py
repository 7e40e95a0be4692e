"""Mixing sources to target weights: nested hash thresholds found by histograms, without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import Staging, cut, join_small, packed

#: Runs of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The hash has LEVELS * STEP bits; each histogram looks at STEP more of them.
STEP, LEVELS = 10, 6
HASH_BITS = STEP * LEVELS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_repeats: float) -> DataFrame:
    """Targets of a table (source string, source_size long): adds weight, target double.

    Sources by code point, null last, take the weights in turn. The budget, share of all sizes, is dealt by weight; a
    target stops at most_repeats times its source's size and the excess is dealt again by weight. That is the level L
    for which the sum of least(cap, L * weight) is the budget: with sources in order of cap / weight it lies behind
    the longest prefix of full sources. One row per source takes part, so one task holds the small table.
    """
    whole = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most_repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = whole.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    # behind the last full source the level is the same for all; where all are full there is none
    final = F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    return ranked.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * final)).select("source", "source_size", "weight", "target")


def thresholds(narrow: DataFrame, targets: DataFrame, stage: Staging) -> DataFrame:
    """Per source: repeats int (every row is taken so often) and limit long (rows whose hash is below, once more).

    narrow: (source, size, hash). A first histogram sums sizes by source and the hash's upper bits; the running sum
    finds the bucket in which the rest of the budget ends. Only that bucket's rows are counted finer, until its hash
    is down to the last bit. The thresholds nest: a larger budget has a larger limit, or more repeats.
    """
    plan = targets.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("repeats") * F.col("source_size"))
    state = stage.table(plan.withColumn("rest", rest).withColumn("limit", F.lit(0).cast("long")))
    rows, done = narrow, []
    running = Window.partitionBy("source").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - STEP * level
        counted = rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        below = stage.table(counted.withColumn("below", F.sum("sum").over(running) - F.col("sum")))
        known = state.select(F.col("source").alias("s"), "rest", "repeats")
        hit = join_small(below, known, F.col("source").eqNullSafe(F.col("s"))).where("below <= rest and below + sum > rest")
        one = hit.where("low = high").select("s", (F.when(F.col("rest") - F.col("below") > F.col("sum") / 2, F.col("high") + 1).otherwise(F.col("low"))).alias("at"))
        more = hit.where("low < high").select("s", F.shiftleft("bucket", shift).alias("at"), F.col("bucket").alias("b"), (F.col("rest") - F.col("below")).alias("left"))
        done.append(stage.table(one))
        more = stage.table(more)
        n = more.count()
        if not n:
            break
        rows = stage.table(join_small(rows.withColumn("bucket", F.shiftright("hash", shift)), more.select("s", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), rows=n).select("source", "size", "hash"))
        state = more.select(F.col("s").alias("source"), F.col("left").alias("rest"), F.lit(0).alias("repeats"))
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    # a source whose rest is at or above all its sizes takes them all: it has no boundary bucket
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    everything = F.when(rest >= F.greatest(F.col("source_size"), F.lit(1)), F.lit(1 << HASH_BITS)).otherwise(F.lit(0))
    return joined.select("source", "source_size", "weight", "target", "repeats", F.when(rest > 0, F.coalesce("at", everything)).otherwise(F.lit(0)).cast("long").alias("limit"))


def mix(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_repeats: float = 2.0) -> DataFrame:
    """How often each row enters the mix: (row struct, size, source_size, target, repeats int, taken long).

    A row's size is its number of words. Sources get targets by source_targets; a row is taken floor(target / size of
    its source) times, and once more where its hash lies below the source's limit, so a source's taken words miss its
    target by half of one row's size at most (rows with the same id and text share one hash and stand or fall
    together). The hash depends on id and text alone: reruns and other orders of the rows agree.

    Weights have to be above 0. Null texts have size 0; null sources are a source of their own, the last; an empty table gives an empty result.
    Columns of df stay inside row, so no name can clash.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights are numbers above 0")
    stage = Staging(df.sparkSession)
    text, ident = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`")
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    hashed = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    marked = packed(df).select("row", F.col(f"row.`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), hashed.alias("hash"))
    try:
        narrow = stage.table(marked.select("source", "size", "hash"))
        targets = stage.table(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_repeats))
        limits = cut(thresholds(narrow, targets, stage).withColumnRenamed("source", "s"))
    finally:
        stage.close()
    out = join_small(marked, limits, F.col("source").eqNullSafe(F.col("s")), "left")
    times = F.col("repeats") + (F.col("hash") < F.col("limit")).cast("int")
    return out.select("row", "size", "source_size", "target", times.alias("repeats"), (F.col("size") * times).alias("taken"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "repeats")
