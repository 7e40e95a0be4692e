"""Suffix-array dedup on a sparse suffix array: suffixes at minimiser positions, sorted, compared with neighbours, extended."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, WordHashes, cut, different_texts, join_small, lean, mix64, packed, rolling

#: Words of the shortest repeat, and of the prefix by which suffixes are ordered and sampled.
MIN_WORDS, PREFIX = 50, 16

#: Suffixes that a range of the sorted order should hold.
RANGE_ROWS = 1_000_000

_WORD = re.compile(r"\S+")
#: What Python's split() leaves between white space, as a Java pattern.
_JAVA_WORD = r"(?U)[^\s\x1c-\x1f]+"


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the leftmost minimum of some window of `width` values, ascending."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    low, at = x.copy(), np.arange(len(x))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = low[:-step], low[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        low = np.where(take, right, left)
        have += step
    return np.unique(at)


class Suffixes:
    """The sampled suffixes of texts: a position is kept if its PREFIX words hash lowest in some window of such prefixes.

    The window is as wide as a repeat of min_words allows, so any min_words equal words have a kept suffix at the same
    place in both texts, with its prefix inside.
    """

    def __init__(self, min_words: int = MIN_WORDS):
        self.min_words, self.width, self.hashes = min_words, min_words - PREFIX + 1, WordHashes()

    def grams(self, text: str) -> np.ndarray:
        return rolling(self.hashes.of(text.split()), PREFIX)

    def anchors(self, grams: np.ndarray) -> np.ndarray:
        return sliding_argmin(grams, self.width)

    def windows(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the min_words words from each position."""
        n = max(0, len(grams) - (self.min_words - PREFIX))
        out = np.zeros((2, n), np.uint64)
        with np.errstate(over="ignore"):
            for at in [*range(0, self.min_words - PREFIX, PREFIX), self.min_words - PREFIX] if n else []:
                for i, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    out[i] = mix64(out[i] * np.uint64(odd) + grams[at : at + n])
        return out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def sorted_runs(stage: Staging, suffixes: DataFrame, prefix: list[str], place: str) -> DataFrame:
    """The suffixes whose prefix occurs in another text too, with keeper, the least key of the texts that have it.

    suffixes: a staged table of the prefix columns (longs that stand for the first words), key, and place in the text.
    They are sorted by prefix, key and place over all machines, so equal prefixes are neighbours; one pass over each
    sorted range compares them. Ranges are cut within a prefix too, by key, however common it is: what a range begins
    or ends with is put together with its other parts by hash aggregation, at most two prefixes per range.
    """
    spark, names = suffixes.sparkSession, [*prefix, "key", place]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // RANGE_ROWS))
    ordered = suffixes.select(*names).repartitionByRange(parts, *names).sortWithinPartitions(*names)
    kinds = [(f.name, f.dataType.simpleString()) for f in ordered.schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None  # the rows since the last change of prefix
        first = True

        def runs(rows: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            nonlocal first
            change = np.zeros(len(rows[0]) - 1, bool)
            for x in rows[: len(prefix)]:
                change |= x[1:] != x[:-1]
            start = np.concatenate([[0], np.flatnonzero(change) + 1])
            end = np.append(start[1:], len(rows[0])) - 1
            key = rows[len(prefix)]
            border = np.zeros(len(start), bool)
            border[0], border[-1] = first, True
            done = len(rows[0]) if last else int(start[-1])
            # keys ascend within a run, so its first key is the keeper and its last tells whether there are others
            good = border | (key[start] != key[end])
            size = end - start + 1
            take = np.repeat(good, size)[:done]
            out = [x[:done][take] for x in rows]
            extra = [np.repeat(key[start], size)[:done][take], np.repeat(border, size)[:done][take]]
            if done:
                first = False
            kinds_ = [pa.int64() if t == "bigint" else pa.int32() for _, t in kinds]
            batch = pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, kinds_, strict=True)), pa.array(extra[0], pa.int64()), pa.array(extra[1], pa.bool_())], [*names, "keeper", "border"])
            return batch, [x[done:] for x in rows]

        for batch in batches:
            if batch.num_rows:
                new = [batch.column(n).to_numpy() for n in names]
                kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
                out, kept = runs(kept, False)
                yield out
                if len(kept[0]) > 4 * batch.num_rows:  # a prefix beyond all measure: hand on what there is of it
                    out = runs(kept, True)[0]
                    yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(np.ones(out.num_rows, bool))], out.schema.names)
                    first, kept = True, None
        if kept is not None:
            yield runs(kept, True)[0]

    found = stage.table(ordered.mapInArrow(lean(scan), ", ".join(f"{n} {t}" for n, t in [*kinds, ("keeper", "bigint"), ("border", "boolean")])))
    ends = found.where("border").groupBy(*prefix).agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most").collect()
    # at most two prefixes per range: every task holds them all, and each row is looked up once
    keepers = spark.sparkContext.broadcast({tuple(r[c] for c in prefix): r["least"] for r in ends})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = keepers.value.get
        for batch in batches:
            keeper = [get(x) for x in zip(*(batch.column(c).to_pylist() for c in prefix), strict=True)]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(keeper, pa.int64())], [*names, "keeper"])
            yield out.filter(out.column("keeper").is_valid())

    settled = found.where("border").select(*names).mapInArrow(lean(settle), ", ".join(f"{n} {t}" for n, t in [*kinds, ("keeper", "bigint")]))
    return found.where("not border").select(*names, "keeper").union(settled)


def repeats(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS):
    """Maximal runs of at least min_words words that different texts share, and the function that gives a text column its key.

    A table with a row per different text that has some: (key long, first (least id with that text), copied boolean
    (other ids have the whole text), n_words int, spans array<struct<start int, words int, keeper long, removed
    boolean>>), ready in the shared folder. key stands for the text. Of the texts that hold a passage the one with the
    smallest key keeps it; in the others it is marked removed. spans are ordered; keeper is the key of a text that
    holds the span's first words and keeps them.

    1. Suffixes at minimiser positions are sorted by their first PREFIX words (their hash) and compared with their
       neighbours; those whose prefix another text has stay.
    2. Those are extended left, word by word, as far as a match of min_words words around them can begin, and right to
       min_words words; the extended suffixes are sorted and compared with their neighbours as well. One that has an
       equal neighbour from another text starts a match, and a maximal match is the union of such suffixes, exact to
       the word. Extending a suffix of step 1 with its own two neighbours alone would miss a match whose two parts,
       left and right of it, are longest with different texts.
    Words are separated by white space; matches of min_words words are told by 128 bits. Copies of a text are one text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, met = Suffixes(min_words), set()
        for batch in batches:
            grams, at, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                if key in met:  # a copy of a text that this task has had
                    continue
                if len(met) > 100_000:
                    met.clear()
                met.add(key)
                g = s.grams(text.as_py())
                a = s.anchors(g)
                grams.append(g[a])
                at.append(a)
                of.append(np.full(len(a), key))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(grams)), pa.array(np.concatenate(of), pa.int64()), pa.array(np.concatenate(at), pa.int32())], ["prefix", "key", "at"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Suffixes(min_words)
        for batch in batches:
            for key, text, places in zip(batch.column("key"), batch.column("text"), batch.column("places"), strict=True):
                one, two = s.windows(s.grams(text.as_py()))
                near = np.zeros(len(one) + 1, np.int64)
                for a in places.as_py():
                    near[max(0, a - s.width + 1)] += 1
                    near[min(a + 1, len(one))] -= 1
                start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                yield pa.RecordBatch.from_arrays([_signed(one[start]), _signed(two[start]), pa.array(np.full(len(start), key.as_py()), pa.int64()), pa.array(start, pa.int32())], ["window", "check", "key", "start"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("keeper", pa.int64()), ("removed", pa.bool_())]))
        for batch in batches:
            out = []
            for key, found in zip(batch.column("key").to_pylist(), batch.column("found").to_pylist(), strict=True):
                spans: list[dict] = []
                for w in found:
                    gone = w["keeper"] != key
                    if spans and spans[-1]["removed"] == gone and w["start"] <= spans[-1]["start"] + spans[-1]["words"]:
                        spans[-1]["words"] = w["start"] + min_words - spans[-1]["start"]
                    else:
                        spans.append({"start": w["start"], "words": min_words, "keeper": w["keeper"], "removed": gone})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind)], ["key", "spans"])

    stage = Staging(spark)
    try:
        found, key_of = different_texts(stage, rows)
        keyed = rows.withColumn("key", key_of("text"))
        suffixes = stage.table(keyed.select("key", "text").mapInArrow(lean(sample), "prefix long, key long, at int"))
        hits = stage.table(sorted_runs(stage, suffixes, ["prefix"], "at").groupBy("key").agg(F.collect_set("at").alias("places")))
        stage.drop(suffixes)
        chosen = stage.table(hits.join(found, "key").select(F.col("key").alias("k"), "first", "places"))
        # nearly every text is chosen, so at any size texts and places meet by one exchange: one plan, whose disk grows with the input
        wanted = keyed.join(chosen.hint("merge"), (F.col("k") == F.col("key")) & F.col("id").eqNullSafe(F.col("first")))
        windows = stage.table(wanted.select("key", "text", "places").mapInArrow(lean(around), "window long, check long, key long, start int"))
        copied = found.where("first < last").select(F.col("key").alias("c"), F.col("first").alias("f"))
        lengths = join_small(keyed, stage.table(copied), (F.col("key") == F.col("c")) & F.col("id").eqNullSafe(F.col("f"))).groupBy("key").agg(F.max(F.regexp_count("text", F.lit(_JAVA_WORD))).alias("n_words"))
        texts = stage.table(found.select("key", "first").join(lengths, "key", "left").select("key", "first", F.col("n_words").isNotNull().alias("copied"), F.coalesce("n_words", F.lit(0)).alias("n_words")))
        matches = sorted_runs(stage, windows, ["window", "check"], "start")
        found = matches.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "keeper"))).alias("found"))
        spans = found.mapInArrow(lean(joined), "key long, spans array<struct<start:int,words:int,keeper:bigint,removed:boolean>>")
        out = texts.join(spans, "key", "left").where(F.col("spans").isNotNull() | (F.col("copied") & (F.col("n_words") >= min_words)))
        return cut(out.select("key", "first", "copied", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,words:int,keeper:bigint,removed:boolean>>")).alias("spans"))), key_of
    finally:
        stage.close()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, number of words); what lies between kept words stays.

    A text that loses nothing comes back unchanged.
    """
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, n in spans:
        n = min(n, len(places) - start)
        out.append(text[at : places[start][0]])
        at = places[start + n][0] if start + n < len(places) else len(text)
    return "".join([*out, text[at:]]).strip()


def dedup(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(row struct, clean_text, n_removed int): each row with its text less the passages that another text keeps.

    Rows with equal texts of at least min_words words: those of the least id keep theirs, the others' is empty. A row
    that loses nothing has its text unchanged; a null text stays null; rows with the same id and text fare alike. Texts
    below min_words words are never touched. Columns of df stay inside row. An empty table gives an empty result.
    """
    marks, key_of = repeats(df, text_col=text_col, id_col=id_col, min_words=min_words)
    todo = marks.where(F.col("copied") | F.exists("spans", lambda s: s["removed"])).select(F.col("key").alias("k"), "first", "copied", F.col("n_words").alias("n"), F.filter("spans", lambda s: s["removed"]).alias("cuts"))
    rows = packed(df).withColumn("key", key_of(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))))
    linked = join_small(rows, todo, F.col("key") == F.col("k"), "left", bytes_=F.size("cuts") * 24)
    copy = F.coalesce(F.col("copied") & (F.col("n") >= min_words) & ~F.col(f"row.`{id_col}`").eqNullSafe(F.col("first")), F.lit(False))
    ready = linked.select("row", F.col(f"row.`{text_col}`").alias("text"), copy.alias("copy"), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = [], []
            for text, is_copy, cuts in zip(batch.column("text"), batch.column("copy"), batch.column("cuts"), strict=True):
                t, spans = text.as_py(), [(c["start"], c["words"]) for c in cuts.as_py() or []]
                if is_copy.as_py() and t:
                    spans = [(0, len(t.split()))]
                if t and spans:
                    spans = _merged(spans)
                    t = without(t, spans)
                texts.append(t)
                lost.append(sum(n for _, n in spans))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(lost, pa.int32())], ["row", "clean_text", "n_removed"])

    kind = ready.schema["row"].dataType.simpleString()
    return ready.mapInArrow(lean(run), f"row {kind}, clean_text string, n_removed int")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, n in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n - out[-1][0]))
        else:
            out.append((start, n))
    return out


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks, key_of = repeats(docs)
    firsts = marks.select(F.col("key").alias("keeper_key"), F.col("first").alias("keeper_doc_id"))
    whole = F.struct(F.lit(0).alias("start"), F.col("n_words").alias("words"), F.col("key").alias("keeper"), F.lit(None).cast("boolean").alias("removed"))
    listed = marks.select("key", "first", F.explode(F.concat("spans", F.when(F.col("copied") & (F.col("n_words") >= MIN_WORDS), F.array(whole)).otherwise(F.array().cast("array<struct<start:int,words:int,keeper:bigint,removed:boolean>>")))).alias("s"))
    listed = join_small(listed.select("key", "first", "s.*"), firsts, F.col("keeper") == F.col("keeper_key"), "left").drop("keeper_key")
    ids = docs.select("doc_id", key_of(F.coalesce("text", F.lit(""))).alias("k"))
    gone = F.coalesce(F.col("removed"), ~F.col("doc_id").eqNullSafe(F.col("first")))
    return ids.join(listed, F.col("k") == F.col("key")).select("doc_id", F.col("start").alias("start_word"), F.col("words").alias("n_words"), "keeper_doc_id", gone.alias("removed"))
