"""Sharding by histogram sort: exact byte histograms over key prefixes, refined until the splitters fit, one exchange."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import Staging, join_small, packed, text_bytes

#: Bits of the key that come from the text; the others come from the id, so that a large group of equal texts can be cut.
TEXT_BITS, ID_BITS = 36, 24
KEY_BITS = TEXT_BITS + ID_BITS
#: The first histogram has 2**FIRST bins, each refinement cuts a bin in 2**NEXT.
FIRST, NEXT = 12, 6
#: Bytes of text that a part should have at most.
PART_BYTES = 256 << 20


def sort_key(text: Column, ident: Column) -> Column:
    """A key of KEY_BITS bits by MD5: equal texts lie together, and within them rows are spread by a digest of the id."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    own = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
    return F.conv(F.concat(F.substring(digest, 1, TEXT_BITS // 4), F.substring(own, 1, ID_BITS // 4)), 16, 10).cast("long")


@dataclass
class Splitters:
    """keys[i] is the first key of part i + 1; rows and size lie below it."""

    keys: list[int]
    rows: list[int]
    size: list[int]
    total_rows: int
    total_size: int
    rounds: int


def find_splitters(narrow: DataFrame, parts: int, tolerance: float, stage: Staging | None = None) -> Splitters:
    """Splitters of a table (key long, size long) into parts of near equal bytes.

    Each round counts exact bytes and rows of candidate key ranges over all partitions (a partial and a final hash
    aggregation), keeps the ranges that hold a wanted boundary and cuts only those finer. A boundary is settled when
    its range holds at most tolerance * (bytes of a part), or a single key. At most 2**FIRST rows reach the driver in
    the first round, (parts - 1) * 2**NEXT in a later one, whatever the table's size.
    """
    shift = KEY_BITS - FIRST
    got = narrow.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    bins = sorted((r["bin"], r["size"], r["n"]) for r in got)
    total, count = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not count:
        return Splitters([0] * (parts - 1), [0] * (parts - 1), [0] * (parts - 1), 0, 0, 1)
    targets = {i: total * i / parts for i in range(1, parts)}
    most = tolerance * total / parts
    #: range (depth's shift, bin) -> bytes and rows below it, and its counted bins
    known: dict[int, tuple[int, int, int]] = {}
    open_ranges = {None: (0, 0, bins, list(targets))}
    rounds = 1
    while open_ranges:
        next_ranges: dict[int, tuple[int, int, list[int]]] = {}
        for below, n_below, counted, wanted in open_ranges.values():
            starts, at, n_at = [], below, n_below
            for b, size, n in counted:
                starts.append((b, at, n_at, size, n))
                at, n_at = at + size, n_at + n
            offsets = [s[1] for s in starts]
            for i in wanted:
                b, lo, n_lo, size, n = starts[max(0, bisect.bisect_right(offsets, targets[i]) - 1)]
                if size <= most or shift == 0:
                    near_end = targets[i] - lo > size / 2
                    known[i] = ((b + near_end) << shift, n_lo + n * near_end, lo + size * near_end)
                else:
                    next_ranges.setdefault(b, (lo, n_lo, []))[2].append(i)
        if not next_ranges:
            break
        finer = max(0, shift - NEXT)
        parents = narrow.sparkSession.createDataFrame([(b,) for b in next_ranges], "parent long")
        narrow = join_small(narrow.withColumn("parent", F.shiftright("key", shift)), parents, "parent", rows=len(next_ranges)).select("key", "size", "parent")
        if stage is not None and rounds % 3 == 1:  # later rounds read the open ranges alone
            narrow = stage.table(narrow)
        hit, narrow = narrow, narrow.select("key", "size")
        got = hit.groupBy("parent", F.shiftright("key", finer).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        by: dict[int, list] = {b: [] for b in next_ranges}
        for r in got:
            by[r["parent"]].append((r["bin"], r["size"], r["n"]))
        open_ranges = {b: (lo, n_lo, sorted(by[b]), wanted) for b, (lo, n_lo, wanted) in next_ranges.items()}
        shift, rounds = finer, rounds + 1
    settled = [known[i] for i in range(1, parts)]
    for i in range(1, len(settled)):  # boundaries never cross
        settled[i] = max(settled[i], settled[i - 1])
    return Splitters([s[0] for s in settled], [s[1] for s in settled], [s[2] for s in settled], count, total, rounds)


def _part_of(key: Column, keys: list[int], lo: int, hi: int) -> Column:
    """The number of splitters at or below key, by a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(keys[mid]), _part_of(key, keys, lo, mid)).otherwise(_part_of(key, keys, mid + 1, hi))


def shard(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", shards: int = 8, parts: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """Rows dealt into shards of near equal bytes: (row struct, size long, shard int, slot long).

    The law is `bytes`: a row's size is its text's UTF-8 bytes (null: none) plus 1, and a boundary misses the equal
    share by tolerance of one part at most, or by half of the one key that no boundary can cut: with tolerance 0 the
    histograms are refined until each boundary lies beside one key. Equal texts share the upper
    bits of the key, so they stay in one shard, in neighbouring slots, unless a boundary has to cut their group to
    keep the law. Each shard is made of parts (in all at least spark.sql.shuffle.partitions, and enough for PART_BYTES each): a part is one task of
    the only exchange that moves texts, so a shard of any size is never gathered in one task; a slot is the number of
    rows of the shard's earlier parts, which the histogram knows, plus the row's number in its part.

    Null ids and texts count like other values; rows that repeat wholly (same id and text) share one key and stay in
    one part. An empty table gives an empty result. Columns of df stay inside row, so no name can clash.
    """
    spark = df.sparkSession
    if parts is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = packed(df).select("row", (text_bytes(F.col(f"row.`{text_col}`")) + 1).alias("size"), sort_key(F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`")).alias("key"))
    stage = Staging(spark)
    try:
        narrow = stage.table(keyed.select("key", "size"))
        per = max(1, -(-parts // shards), -(-(narrow.agg(F.sum("size")).first()[0] or 0) // (shards * PART_BYTES)))
        parts = per * shards
        found = find_splitters(narrow, parts, tolerance, stage)
    finally:
        stage.close()
    rows = [0, *found.rows]
    base = [rows[p] - rows[p - p % per] for p in range(parts)]
    part = _part_of(F.col("key"), found.keys, 0, parts - 1)
    dealt = keyed.withColumn("part", part.cast("int")).repartitionById(parts, F.col("part"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("key", F.col(f"row.`{id_col}`")))
    offset = F.element_at(F.array(*[F.lit(b) for b in base]).cast("array<bigint>"), F.col("part") + 1)
    return dealt.withColumn("n", number).select("row", "size", (F.col("part") / F.lit(per)).cast("int").alias("shard"), (offset + F.col("n") - 1).alias("slot"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
