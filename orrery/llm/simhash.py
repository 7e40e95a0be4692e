"""SimHash fingerprints: term hashes vote on signed bits; permuted block tables find all within a Hamming radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import packed

#: A fingerprint is a struct of two longs, high and low.
BITS = 128
_LANES = 32
_MASK = (1 << 32) | 1


def terms(text: Column) -> Column:
    """Adjacent pairs of words, the last word once alone: array<struct<a, b>>. An empty text has one empty term."""
    words = F.split(text, r"\s+")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))


def _votes() -> list[Column]:
    """For either hash and each of 32 shifts: a sum whose two halves count the rows with bit j, and with bit j + 32, set."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_MASK))).alias(f"{h}_{j}") for h in ("h0", "h1") for j in range(_LANES)]


def _signs(h: str) -> Column:
    out = None
    for j in range(_LANES):
        both = F.col(f"{h}_{j}")
        for count, bit in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), j), (F.shiftrightunsigned(both, 32), j + 32)):
            vote = F.when(count * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))
            out = vote if out is None else out.bitwiseOR(vote)
    return out


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fingerprint struct<high, low>: a bit is set if over half of the text's terms, each as often as it occurs,
    have it set in their hash. A null text counts as an empty one; rows with equal keys vote together.

    The words never leave their task: votes are summed by hash aggregation behind explode, in one generated loop, and
    up to 2**32 terms of a text are counted exactly.
    """
    exploded = df.select(*keys, F.inline(terms(F.coalesce(F.col(text), F.lit("")))))
    a, b = exploded.columns[-2:]
    hashed = exploded.select(*keys, F.xxhash64(a, b).alias("h0"), F.xxhash64(F.lit(1), F.col(a), F.col(b)).alias("h1"))
    return hashed.groupBy(*keys).agg(F.count("*").alias("n"), *_votes()).select(*keys, F.struct(_signs("h0").alias("high"), _signs("h1").alias("low")).alias("fingerprint"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fingerprint["high"]), 16, "0"), F.lpad(F.hex(fingerprint["low"]), 16, "0")))


def distance(x: Column, y: Column) -> Column:
    return F.bit_count(x["high"].bitwiseXOR(y["high"])) + F.bit_count(x["low"].bitwiseXOR(y["low"]))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - distance(x, y) / F.lit(float(BITS))


def _block(fp: Column, start: int, width: int) -> Column:
    """Bits start .. start + width of the 128, for blocks inside one half."""
    half = fp["high"] if start >= 64 else fp["low"]
    return F.shiftrightunsigned(half, start % 64).bitwiseAND(F.lit((1 << width) - 1))


def near_fingerprints(found: DataFrame, radius: int = 3, blocks: int = 8, agree: int | None = None) -> DataFrame:
    """All pairs of different fingerprints within the Hamming radius: (a struct, b struct, hamming int), a below b.

    found: a column fingerprint. Equal fingerprints are merged first, so copies make no pairs. The bits form blocks of
    equal width; within the radius at least blocks - radius of them agree, so a table for each choice of that many
    blocks, keyed by their bits, holds every pair (the permuted tables of the public SimHash papers). A pair is kept
    in the first table that holds it, then measured, so none is lost or repeated.
    """
    agree = blocks - radius if agree is None else agree
    width = BITS // blocks
    if 64 % width or agree < 1 or agree > blocks - radius:
        raise ValueError("blocks must divide a half evenly and outnumber the radius")
    distinct = found.select("fingerprint").where("fingerprint is not null").distinct()
    tables = list(combinations(range(blocks), agree))
    keyed = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[_block(F.col("fingerprint"), c * width, width) for c in chosen]).alias("key")) for t, chosen in enumerate(tables)])
    rows = distinct.select("fingerprint", F.inline(keyed))
    left, right = rows.select(F.col("fingerprint").alias("a"), "table", "key"), rows.select(F.col("fingerprint").alias("b"), "table", "key")
    pairs = left.join(right, ["table", "key"]).where("a < b").withColumn("hamming", distance(F.col("a"), F.col("b"))).where(F.col("hamming") <= radius)
    same = F.array(*[F.xxhash64(*[_block(F.col("a"), c * width, width) for c in chosen]) == F.xxhash64(*[_block(F.col("b"), c * width, width) for c in chosen]) for chosen in tables])
    return pairs.where(F.array_position(same, True) == F.col("table") + 1).select("a", "b", "hamming")


def with_next(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows in order of descending id with the next row's text, the last row's next being the first.

    Returns (bucket, number, row struct, next_text, ghost). Buckets are ranges of ids between approximate quantiles; a
    copy (ghost) of each bucket's first row is added to the bucket before it, so that one exchange by bucket puts each
    row beside its next and no window spans the table. Rows of one id (or none) are ordered by a hash of their text.
    """
    rows = packed(df).select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(F.col(f"row.`{text_col}`")).alias("tie"))
    probes = [i / parts for i in range(1, parts)]
    numeric = df.select(F.col(f"`{id_col}`").cast("double").alias("id"))
    cuts = sorted(set(numeric.approxQuantile("id", probes, 0.1 / parts))) if probes else []

    def bucket(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("id").cast("double") >= F.lit(cuts[mid]), bucket(lo, mid)).otherwise(bucket(mid + 1, hi))

    cuts = cuts[::-1]
    rows = rows.withColumn("bucket", bucket(0, len(cuts)))
    place = F.struct(F.col("id").isNotNull().alias("is"), "id", "tie")
    firsts = {r["bucket"]: r["p"] for r in rows.select("bucket", place.alias("p")).groupBy("bucket").agg(F.max("p").alias("p")).collect()}
    order = sorted(firsts)
    ahead = [(order[i - 1], firsts[b]["id"], firsts[b]["tie"]) for i, b in enumerate(order)]
    edges = df.sparkSession.createDataFrame(ahead, f"to int, gid {df.select(id_col).dtypes[0][1]}, gtie long")
    ghosts = rows.join(F.broadcast(edges), F.col("id").eqNullSafe(F.col("gid")) & (F.col("tie") == F.col("gtie")))
    every = rows.select("row", "id", "tie", "bucket", F.lit(False).alias("ghost")).union(ghosts.select("row", "id", "tie", F.col("to").alias("bucket"), F.lit(True).alias("ghost")))
    within = Window.partitionBy("bucket").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("tie").desc())
    dealt = every.repartitionById(max(1, len(cuts) + 1), F.col("bucket"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    return dealt.select("bucket", "row", "ghost", F.row_number().over(within).alias("number"), F.coalesce(F.lead(text).over(within), text).alias("next_text"))


def edited_text(text: Column, following: Column) -> Column:
    """The last third (floored) of the code points replaced by as many of the following text's first ones."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next row's text, in order of descending id.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The one exchange
    deals rows by ranges of ids; voting and both looks at the next row happen in its tasks. Null texts are empty;
    equal texts have equal fingerprints; an empty table gives an empty result; only the two named columns are read.
    """
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_next(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", parts)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    edited = placed.select("bucket", "number", "ghost", F.col("row.id").alias("id"), text.alias("text"), edited_text(text, F.col("next_text")).alias("edited"))
    versions = F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("version")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("version")))
    both = edited.select("bucket", "number", "ghost", "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.inline(versions))
    keys = ["bucket", "number", "ghost", "id", "n_chars", "sha"]
    marks = fingerprints(both, [*keys, "is_edited"], "version")
    joined = marks.groupBy(*keys).agg(F.max(F.when(~F.col("is_edited"), F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("is_edited"), F.col("fingerprint"))).alias("efp"))
    after = F.lead("fp").over(Window.partitionBy("bucket").orderBy("number"))
    seen = joined.withColumn("next_fp", F.coalesce(after, F.col("fp"))).where(~F.col("ghost"))
    return seen.select("id", "n_chars", F.col("sha").alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op6_query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
