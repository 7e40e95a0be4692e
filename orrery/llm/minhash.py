"""MinHash near-dedup with Order MinHash sketches: ordered minimal k-mers propose pairs, banded alignment verifies them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import BROADCAST_BYTES, ROW_BYTES, Staging, WordHashes, components, cut, different_texts, join_small, lean, mix64, packed, rolling

#: Words of a k-mer, k-mers of a sketch, and the least edit similarity of a link.
K, MINIMA, SIMILARITY = 5, 2, 0.8
#: Orders of the k-mers, and sketches taken along each: SKETCHES = ORDERS * TURNS of a text.
ORDERS, TURNS = 6, 16
SKETCHES = ORDERS * TURNS
#: Edits soon leave no five words in a row of a short text: texts of at most SHORT words have pairs of words as k-mers.
SHORT, SHORT_K = 64, 2
#: A bucket of at most so many texts is compared pair by pair, a larger one is split by rare words first.
DIRECT = 16
#: Bins in which words are counted, by the first bits of their hash.
BINS, _BIN = 1 << 16, np.uint64(48)
#: Words before one in a text's order, each in a large bucket, that are compared to tell whether it is the first that two texts share.
BEFORE = 16
#: Longs of a text's word_marks.
MARKS = 4

_ODD = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_START = (np.arange(TURNS, dtype=np.uint64) << np.uint64(64 - TURNS.bit_length() + 1))


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers in which equal ones are told apart by their number of occurrence."""
    by = np.argsort(grams, kind="stable")
    same = grams[by]
    start = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(by) else np.zeros(0, np.int64)
    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    out = np.empty_like(grams)
    with np.errstate(over="ignore"):
        out[by] = mix64(same + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def ordered_minima(grams: np.ndarray, orders: int = ORDERS) -> np.ndarray:
    """Hashes of the ordered minima of labelled k-mers.

    Sketch t of an order ranks k-mers by (hash - t / TURNS) modulo 1, so its minima are the ones that follow t / TURNS
    on the circle of hashes: one sort serves all sketches of an order. The minima are taken in the text's order.
    """
    n, take = len(grams), min(MINIMA, len(grams))
    bits = np.uint64(max(1, (n - 1).bit_length()))
    order = np.arange(orders)[:, None]
    with np.errstate(over="ignore"):
        rank = grams * _ODD[:orders, None]
        rank ^= rank >> np.uint64(32)
        rank *= _ODD[100 : 100 + orders, None]
        # the first bits of a rank and the place of its k-mer, so that sorting leaves places to read off
        by = np.sort(rank >> bits << bits | np.arange(n, dtype=np.uint64), axis=1)
        flat = (by >> np.uint64(8)).ravel() | np.repeat(np.arange(orders, dtype=np.uint64) << np.uint64(56), n)
        at = np.searchsorted(flat, (_START >> np.uint64(8) | order.astype(np.uint64) << np.uint64(56)).ravel()).reshape(orders, TURNS) - order * n
        places = by[order[:, :, None], (at[:, :, None] + np.arange(take)) % n] & ((np.uint64(1) << bits) - np.uint64(1))
        places.sort(axis=2)
        value = np.broadcast_to(order + 1, (orders, TURNS)).astype(np.uint64)
        for i in range(take):
            value = value * np.uint64(0x9E3779B97F4A7C15) + grams[places[:, :, i].astype(np.int64)]
    return value.ravel()


def order_sketches(words: np.ndarray) -> np.ndarray:
    """The different Order MinHash sketches of a text, given its words' hashes.

    A sketch is a hash of the MINIMA occurrence-labelled k-mers of least rank, in the text's order: repeats count, and
    moved text changes sketches, which a set would not show. Texts of at most SHORT words have sketches of pairs of
    words, the ends counting as words; those of at least SIMILARITY * SHORT words have sketches of K words. So any
    two texts that may be linked have sketches of one kind.
    """
    out = []
    if len(words) <= SHORT:
        ends = np.concatenate([np.array([1], np.uint64), words, np.array([2], np.uint64)])
        out.append(ordered_minima(labelled(rolling(ends, SHORT_K, 7))))
    if len(words) >= int(SIMILARITY * SHORT):
        out.append(ordered_minima(labelled(rolling(words, K))))
    found = np.sort(np.concatenate(out))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def banded_distance(a: Sequence, b: Sequence, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    What they have in common at either end needs no alignment, and the bags of what is left bound the distance from
    below. Bands that are too narrow for `most` come first: they settle texts that are much alike.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    bag = Counter(a)
    bag.subtract(b)
    low = max(sum(x for x in bag.values() if x > 0), -sum(x for x in bag.values() if x < 0))
    if low > most:
        return most + 1
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    band = max(14, low + low // 4)
    while band < most and band < len(a):
        if (found := _in_band(a, b, where, band)) <= band:
            return found
        band *= 4
    found = _in_band(a, b, where, min(most, len(a)))
    return found if found <= most else most + 1


def _in_band(a: Sequence, b: Sequence, where: dict, most: int) -> int:
    """Edit distance of a and the shorter b if at most `most`, else more than that; where: the places of b's words as bits.

    Only the cells within `most` of the diagonal are computed, a column at a time, as the vertical differences of the
    public bit-parallel algorithms of Myers and Hyyro, held in integers of 2 * most + 1 bits.
    """
    # bit i of a column's window stands for row (column - most + i) of b; bit `most` is the diagonal
    full = (1 << 2 * most + 1) - 1
    vp, vn, score = full & ~((1 << most) - 1), 0, 0
    rows = len(b)
    # score follows the diagonal until its row passes the end of b, then the last row
    for col, x in enumerate(a):
        shift = col - most
        match = where.get(x, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full if match else 0
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if col < rows:
            score += 0 if d0 >> most & 1 else 1
            if score > 2 * most:
                return score
        else:
            at = rows - 1 - shift
            if at < 0:
                return most + 1
            score += (hp >> at & 1) - (hn >> at & 1)
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & full
        vn = down & hp
    return score


def similar(a: Sequence, b: Sequence, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / length of the longer is at least `least`, over words."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    return banded_distance(a, b, most) <= most


def _links(stage: Staging, pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) that alignment confirms, word by word.

    The text with more pairs is fetched first, and the pairs are dealt out by the other one: so the partners of a text
    that has very many are aligned all over the cluster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(x.as_py().split(), y.as_py().split(), least) for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    # counted on the pair's own side alone, which tells a text that has very many from one that has few as well
    pairs = pairs.withColumns({f"n_{side}": F.count("*").over(Window.partitionBy(side)) for side in ("a", "b")})
    more, less = (F.when(F.col("n_a") >= F.col("n_b"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    pairs = stage.table(pairs.select(more.alias("a"), less.alias("b")))
    both = pairs
    for side, name in (("a", "left"), ("b", "right")):
        # where those that are wanted are few enough to be sent to the texts, the others stay where they are
        wanted = stage.table(pairs.select(F.col(side).alias("key")).distinct())
        needed = join_small(texts, wanted, "key", "left_semi") if wanted.count() * ROW_BYTES <= BROADCAST_BYTES else texts
        both = both.join(needed.select(F.col("key").alias(side), F.col("text").alias(name)), side)
    return stage.table(both.select("a", "b", "left", "right").mapInArrow(lean(run), "a long, b long"))


def _may_link(x: str, y: str, least: float, marked: bool = False):
    """Whether texts of x.n and y.n words can be similar.

    marked: as far as word_marks tell, too. A word that only one of two texts has takes an edit, and a mark that only
    one has stands for such a word.
    """
    longer = F.greatest(f"{x}.n", f"{y}.n")
    most = F.floor((1 - least) * longer + 1e-9)
    fine = F.least(f"{x}.n", f"{y}.n") >= longer - most
    for a, b in ((x, y), (y, x)) if marked else ():
        own = [F.bit_count(F.col(f"{a}.m{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.m{i}")))) for i in range(MARKS)]
        fine = fine & (sum(own[1:], own[0]) <= most)
    return fine


def _first_shared(x: str, y: str, least: float):
    """Whether a word that two texts share may be the first such one, in the order of prefix_grams, of two similar texts.

    From that word on either text needs as many words as they must have in common, and no word before it is shared:
    BEFORE of them, of large buckets, are compared. So a pair comes from few of the many buckets that it may share.
    """
    longer = F.greatest(f"{x}.n", f"{y}.n")
    common = longer - F.floor((1 - least) * longer + 1e-9)
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
    return (left >= common) & ~F.arrays_overlap(f"{x}.before", f"{y}.before")


def word_marks(words: np.ndarray) -> np.ndarray:
    """MARKS longs with a bit set for each word, by the first bits of its hash."""
    bits = np.zeros(64 * MARKS, bool)
    bits[(words >> np.uint64(64 - (64 * MARKS - 1).bit_length())).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def prefix_grams(words: np.ndarray, least: float, counts: np.ndarray | None = None) -> np.ndarray:
    """The rarest words of a text, rarest first, so many that two texts of similarity `least` share one of them.

    Equal words are told apart by their number of occurrence, and the end counts as a word that all texts have. An edit
    takes at most one word of the longer text away, so texts within `most` edits have longer + 1 - most of them in
    common; by the prefix principle one of these is among the first n + 2 less that number, in any order that holds for
    all texts. Here those are first that share their bin of `counts` with the fewest. Without counts, all words.
    """
    found = labelled(np.append(words, np.uint64(2)))
    if counts is None:
        return found
    n = len(words)
    longer = np.arange(n, int(n / least) + 2)
    common = int((longer + 1 - ((1 - least) * longer + 1e-9).astype(np.int64)).min())
    return found[np.lexsort((found, counts[(found >> _BIN).astype(np.int64)]))[: n + 2 - common]]


def _split(stage: Staging, keys: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Buckets (bucket, key, n, root, place, marks) by prefix_grams of the given texts (key, root): all their similar pairs meet in one.

    place: of the word in the order of all the text's words, from 0.
    """
    texts = stage.table(join_small(texts, keys, "key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = np.zeros(BINS, np.int64), WordHashes()
        for batch in batches:
            for x in batch.column("text"):
                np.add.at(held, (prefix_grams(hashes.of(x.as_py().split()), least) >> _BIN).astype(np.int64), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bin", "n"])

    counts = np.zeros(BINS, np.int64)
    for r in texts.select("text").mapInArrow(lean(count), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    shared = keys.sparkSession.sparkContext.broadcast(counts)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for x, key, n, root in zip(*(batch.column(c) for c in ("text", "key", "n", "root")), strict=True):
                words = hashes.of(x.as_py().split())
                found = prefix_grams(words, least, shared.value).view(np.int64)
                values = [key.as_py(), n.as_py(), root.as_py(), *word_marks(words).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.arange(len(found)), pa.int64()), *(pa.array(np.full(len(found), v), pa.int64()) for v in values)], ["bucket", "place", *names])

    names = ["key", "n", "root", *(f"m{i}" for i in range(MARKS))]
    return stage.table(texts.mapInArrow(lean(prefix), ", ".join(f"{c} long" for c in ("bucket", "place", *names))))


def _led(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a the smaller, of rows (lead, m, key, n) whose lengths m and n allow a link."""
    both = rows.select(F.struct(F.col("m").alias("n")).alias("p"), F.struct("n").alias("q"), F.least("lead", "key").alias("a"), F.greatest("lead", "key").alias("b"))
    return both.where(_may_link("p", "q", least)).select("a", "b")


def _open(stage: Staging, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, key, n, root, size) of the members of buckets that hold more than one class; one exchange tells all of a bucket."""
    classed = join_small(members.select("bucket", "key", "n"), roots, F.col("key") == F.col("node"), "left").select("bucket", "key", "n", F.coalesce("root", "key").alias("root"))
    each = Window.partitionBy("bucket")
    told = classed.withColumns({"x": F.min("root").over(each), "y": F.max("root").over(each), "size": F.count("*").over(each)})
    return stage.table(told.where("x < y").select("bucket", "key", "n", "root", "size"))


def _second(stage: Staging, left: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the texts outside each bucket's largest class with one of that class, another one in each bucket."""
    classes = left.groupBy("bucket", "root").agg(F.count("*").alias("texts"), F.min(F.struct(F.xxhash64("bucket", "key").alias("h"), "key", "n")).alias("one"))
    largest = classes.groupBy("bucket").agg(F.max(F.struct("texts", "root", "one")).alias("x"))
    largest = stage.table(largest.where("x.texts > 1").select("bucket", F.col("x.root").alias("main"), F.col("x.one.key").alias("lead"), F.col("x.one.n").alias("m")))
    return _led(join_small(left, largest, "bucket").where("root <> main"), least).distinct()


def _across(stage: Staging, placed: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of texts in one bucket that are not of one class and whose lengths, places and marks, if there are any, allow a link.

    Only buckets of more than one class, with `most` those of at most so many texts. The texts outside a bucket's largest class
    meet the others; a class of many texts never meets itself.
    """
    marks = [c for c in placed.columns if c in [f"m{i}" for i in range(MARKS)]]
    ordered = ["place"] if "place" in placed.columns else []
    # dealt by bucket once, which serves the windows of a bucket's classes too
    each, of_class = Window.partitionBy("bucket"), Window.partitionBy("bucket", "root")
    told = placed.select("bucket", "key", "n", "root", *ordered, *marks).repartition("bucket").withColumn("texts", F.count("*").over(of_class))
    told = told.withColumns({"main": F.max(F.struct("texts", "root")).over(each), "least_root": F.min("root").over(each), "last_root": F.max("root").over(each), "size": F.count("*").over(each)})
    told = told.where("least_root < last_root" + (f" and size <= {most}" if most else ""))
    here = told.select("bucket", "key", "n", "root", "size", *ordered, *marks, (F.col("root") == F.col("main.root")).alias("inner"))
    if ordered:
        # where few texts meet, a pair may come twice
        few, none = F.col("size") <= DIRECT, F.array().cast("array<long>")
        larger = F.collect_list("bucket").over(Window.partitionBy("key").orderBy(few, "place").rowsBetween(-BEFORE, -1))
        here = here.withColumn("before", F.when(few, none).otherwise(larger))
    here = stage.table(here)
    p, q = here.where("not inner").alias("p"), here.alias("q")
    meet = (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.root") != F.col("q.root")) & (F.col("q.inner") | (F.col("p.key") < F.col("q.key"))) & _may_link("p", "q", least, bool(marks))
    if ordered:
        meet = meet & _first_shared("p", "q", least)
    pairs = p.join(q, meet).select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b"))
    return pairs.distinct()


def near_classes(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY):
    """Classes of near copies: a table (key long, class_id) with a row per different text, and the function that gives a text column its key.

    Texts are linked if the edit similarity of their words is at least `similarity` (1 - distance / longer) and they
    agree in one of their ordered sketches; classes are the connected components, class_id the least id in one. Equal
    texts are merged before all else, by hash aggregation over 128 bits.

    1. Every text is aligned with the first text (least key) of each of its buckets; the links give first classes. In
       larger buckets of several classes the texts outside the largest are then aligned with one of it, drawn anew for
       each bucket, so that of a family of copies few stay outside.
    2. What is left are pairs across classes. Buckets of at most DIRECT texts are compared pair by pair. The texts of
       larger ones are dealt anew by their rarest words (prefix_grams), of which linked texts share at least one: this
       parts texts that have only a passage in common, loses no link and may add links of texts that agree in no
       sketch. In either, texts outside a bucket's largest class meet the texts of the others.
    Every pair that shares a bucket is thus aligned, of one class already, or ruled out by an exact criterion. Texts
    that no criterion parts are compared pair by pair, so their cost grows with the square of their number.
    """
    spark = df.sparkSession
    stage = Staging(spark)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = WordHashes(), set()
        for batch in batches:
            buckets, keys, sizes = [np.zeros(0, np.uint64)], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                if key in met:  # a copy of a text that this task has had
                    continue
                if len(met) > 100_000:
                    met.clear()
                met.add(key)
                words = hashes.of(text.as_py().split())
                buckets.append(order_sketches(words))
                keys.append(key)
                sizes.append(len(words))
            each = [len(x) for x in buckets[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64), pa.int64()), *(pa.array(np.repeat(np.array(x, np.int64), each), pa.int64()) for x in (keys, sizes))], ["bucket", "key", "n"])

    try:
        texts, key_of = different_texts(stage, rows)
        keyed = rows.withColumn("key", key_of("text"))
        members = keyed.select("key", "text").mapInArrow(lean(sketch), "bucket long, key long, n long")
        # one exchange: the sketches are neither kept nor dealt out a second time to meet their bucket's least key
        each = Window.partitionBy("bucket")
        placed = members.withColumns({"lead": F.min("key").over(each), "last": F.max("key").over(each)})
        # a text whose copies were met in several tasks has its rows once
        placed = stage.table(placed.where("lead < last").select("bucket", "key", "n", "lead").distinct())
        sizes = stage.table(placed.groupBy("key").agg(F.max("n").alias("n")))
        wanted = sizes.join(texts, "key").select(F.col("key").alias("k"), "n", "first")
        chosen = join_small(keyed, stage.table(wanted), (F.col("k") == F.col("key")) & F.col("id").eqNullSafe(F.col("first")))
        chosen = stage.table(chosen.select("key", "text", "n"))
        if chosen.count() > sizes.count():  # rows that repeat an id and its text
            chosen = stage.table(chosen.dropDuplicates(["key"]))

        led = placed.where("key <> lead").select("lead", "key", "n").distinct()
        led = led.join(sizes.select(F.col("key").alias("lead"), F.col("n").alias("m")), "lead")
        tested = stage.table(_led(led, similarity))
        links = _links(stage, tested, chosen, similarity)
        roots = components(links)

        left = _open(stage, placed, roots)
        stage.drop(placed)
        pairs = stage.table(_second(stage, left.where(F.col("size") > DIRECT), similarity).join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            roots = components(_links(stage, pairs, chosen, similarity).union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            tested, left = tested.union(pairs), _open(stage, left, roots)
        pairs = _across(stage, left.where(F.col("size") <= DIRECT), similarity)
        hot = stage.table(left.where(F.col("size") > DIRECT).select("key", "root").distinct())
        if not hot.isEmpty():
            pairs = pairs.union(_across(stage, _split(stage, hot, chosen, similarity), similarity)).distinct()
        more = stage.table(pairs.join(tested, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            found = _links(stage, more, chosen, similarity)
            if not found.isEmpty():
                roots = components(found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        classed = join_small(texts, roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root"))
        named = stage.table(classed.where("root <> key").select("root").distinct().withColumnRenamed("root", "r"))
        groups = join_small(classed, named, F.col("root") == F.col("r")).groupBy("root").agg(F.min("first").alias("least"))
        out = classed.join(groups.withColumnRenamed("root", "g"), F.col("root") == F.col("g"), "left")
        return cut(out.select("key", F.coalesce("least", "first").alias("class_id"))), key_of
    finally:
        stage.close()


def near_dedup(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(row struct, class_id, kept boolean) of every row; kept rows are those whose id is their class's least.

    Null and empty texts are equal texts and form one class, as do texts of white space alone. Rows with the same id
    and text fare alike; null ids count as larger than others and a class without any other keeps all its rows.
    Columns of df stay inside row. An empty table gives an empty result.
    """
    classes, key_of = near_classes(df, text_col=text_col, id_col=id_col, similarity=similarity)
    rows = packed(df).withColumn("key", key_of(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))))
    out = join_small(rows, classes.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    return out.select("row", "class_id", F.col(f"row.`{id_col}`").eqNullSafe(F.col("class_id")).alias("kept"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "class_id", "kept")
