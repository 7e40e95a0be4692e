"""Toxicity scores: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, and their votes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, lean, packed

_TOKEN = re.compile(r"[^\W_]+")

#: Default of `fit(max_labelled=)`: the labelled rows a model learns from, those whose ids hash lowest.
MAX_LABELLED = 5_000
#: Terms in more than one of COMMON examples are held as rows of weights, at most ROWS of them.
COMMON, ROWS = 16, 512
#: Texts whose products with these rows are taken at once; always so many, so that a text's do not depend on the others.
TOGETHER = 64
#: A word's IDF counts in full where its counts by label have a log-likelihood ratio well above TELLING (chance words
#: of some hundred thousand stay below), and to the share FLOOR where they do not differ.
TELLING, FLOOR = 14.0, 0.03


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _least_shingles(text: str | None) -> tuple[str, str]:
    """The five-word shingles of least hash under two seeds (the whole text where it is shorter)."""
    words = tokens(text)
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return tuple(f"{min(xxhash.xxh64_intdigest(x, seed) for x in shingles):x}" for seed in (0, 1))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0] + 1, ... of every run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


# --- index ---------------------------------------------------------------------------------------------------------


class BlockMaxIndex:
    """Sparse vectors of examples, inverted: postings by term, then example. Every `width` consecutive examples form a block.

    The postings of a term in a block lie together; of each such stretch the largest weight is known. The commonest
    terms, whose postings reach nearly all blocks, are rows of weights of all examples: their part of a product is known
    exactly before any block is opened, and so is its largest in each block.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int, width: int = 128):
        self.n, self.width = len(vectors), width
        each = np.array([len(ids) for ids, _ in vectors], np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in vectors)]).astype(np.int64)
        weights, of = np.concatenate([np.zeros(0), *(w for _, w in vectors)]), np.repeat(np.arange(self.n), each)
        seen = np.bincount(ids, minlength=size)
        common = np.argsort(-seen, kind="stable")[:ROWS]
        common = common[seen[common] * COMMON > self.n]
        self.row = np.full(size, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        dense = self.row[ids] >= 0
        self.rows[self.row[ids[dense]], of[dense]] = weights[dense]
        ids, weights, of = ids[~dense], weights[~dense], of[~dense]
        by = np.lexsort((of, ids))
        terms = ids[by]
        self.example, self.weights = of[by], weights[by]
        block = self.example // width
        first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])) if len(by) else np.zeros(0, np.int64)
        self.blocks = -(-self.n // width)
        self.start, self.long = first, np.diff(np.append(first, len(by)))
        self.block, self.most = block[first], np.maximum.reduceat(self.weights, first) if len(by) else np.zeros(0)
        self.term_start = np.searchsorted(terms[first], np.arange(size + 1))

    def common_parts(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The common terms' part of each query's product with every example, and its largest in each block."""
        edges = np.arange(0, self.n, self.width)
        for at in range(0, len(queries), TOGETHER):
            some, held = queries[at : at + TOGETHER], np.zeros((TOGETHER, len(self.rows)))
            for i, (ids, weights) in enumerate(some):
                row = self.row[ids]
                held[i, row[row >= 0]] = weights[row >= 0]
            part = held @ self.rows
            most = np.maximum.reduceat(part, edges, axis=1) if self.n else np.zeros((TOGETHER, 0))
            yield from zip(part[: len(some)], most, strict=False)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[float, int]]:
        """The k examples of largest product above 0 with a sparse vector, exactly; ties by the lower number.

        Blocks are opened by descending bound (the largest part of the common terms, and the sum of query weight times
        block maximum of the others), four times as many at each step, until no bound reaches the k-th product found.
        common: the query's common_parts, if they are at hand.
        """
        part, most = next(self.common_parts([(ids, weights)])) if common is None else common
        held = self.row[ids] >= 0
        ids, weights = ids[~held], weights[~held]
        begin = self.term_start[ids]
        size = self.term_start[ids + 1] - begin
        at, w = _runs(begin, size), np.repeat(weights, size)
        block = self.block[at]
        bounds = np.bincount(block, self.most[at] * w, self.blocks) + most
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        scores, numbers, step = np.zeros(0), np.zeros(0, np.int64), 10
        while len(order) and (len(scores) < k or bounds[order[0]] >= scores[-1] - 1e-12):
            # of the blocks that are next, those whose bound is still high enough
            least = scores[-1] - 1e-12 if len(scores) == k else 0.0
            some, order = order[:step], order[step:]
            some = some[bounds[some] >= least]
            step *= 4
            opened = np.zeros(self.blocks, bool)
            opened[some] = True
            here = np.flatnonzero(opened[block])
            stretches = at[here]
            long = self.long[stretches]
            postings = _runs(self.start[stretches], long)
            found = np.bincount(self.example[postings], self.weights[postings] * np.repeat(w[here], long), self.n) + part
            hit = np.flatnonzero(found > least)
            hit = hit[opened[hit // self.width]]
            scores, numbers = np.concatenate([scores, found[hit]]), np.concatenate([numbers, hit])
            if len(scores) > 4 * k:  # those that tie with the k-th stay
                top = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                scores, numbers = scores[top], numbers[top]
            best = np.lexsort((numbers, -scores))[:k]
            scores, numbers = scores[best], numbers[best]
        return list(zip(scores.tolist(), numbers.tolist(), strict=True))


# --- model ---------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray  # of each term, by how far it tells the labels apart
    unseen: float  # of a word that no example has
    index: BlockMaxIndex | None = None
    positive: np.ndarray | None = None  # labelled rows behind each distinct example vector
    total: np.ndarray | None = None
    names: list | None = None  # an id of each
    bare: float = 0.0  # score of a text without any word of an example
    prior: float = 0.0
    k: int = 15
    slope: float = 1.0
    offset: float = 0.0

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of a text, ascending, how often each occurs, and how often each word occurs that no example has."""
        found = Counter(tokens(text))
        terms = np.fromiter(map(self.terms.get, found, repeat(-1)), np.int64, len(found))
        counts = np.fromiter(found.values(), np.int64, len(found))
        by = np.argsort(terms, kind="stable")
        by, known = by[np.count_nonzero(terms < 0) :], terms >= 0
        return terms[by], counts[by], counts[~known]

    def vector(self, terms: np.ndarray, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Unit TF-IDF weights of the terms; the other words count in the length alone."""
        w, rest = (1 + np.log(counts)) * self.idf[terms], (1 + np.log(others)) * self.unseen
        length = math.sqrt(w @ w + rest @ rest)
        return w / length if length > 0 else w

    def near(self, texts: list[str | None]) -> Iterator[list[tuple[float, int]]]:
        """The nearest examples of each text."""
        for at in range(0, len(texts), TOGETHER):
            counted = [self.counts(t) for t in texts[at : at + TOGETHER]]
            found = [(c[0], self.vector(*c)) for c in counted]
            parts = self.index.common_parts(found) if self.index else found
            for (terms, weights), common in zip(found, parts, strict=True):
                yield self.index.nearest(terms, weights, self.k, common) if len(terms) and self.index else []

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, each weighted by its cosine to the fourth, pulled to the prior."""
        top = all_ = 0.0
        for cosine, i in near:
            w = (cosine / near[0][0]) ** 4
            top, all_ = top + w * self.positive[i], all_ + w * self.total[i]
        return (top + self.prior * 0.5) / (all_ + 0.5)

    def calibrated(self, share: float) -> float:
        x = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * x + self.offset))))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """The score of each text, and its three nearest examples."""
        return [(self.calibrated(self.vote(near)), near[:3]) if near else (self.bare, []) for near in self.near(texts)]


def _platt(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through leave-one-out shares, with a light pull towards the identity."""
    x = np.log(np.clip(shares, 1e-9, 1) / np.clip(1 - shares, 1e-9, 1))
    a, b, pull = 1.0, 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        d, h = weights * (p - labels), weights * p * (1 - p) + 1e-12
        g = np.array([(d * x).sum() + pull * (a - 1), d.sum() + pull * b])
        m = np.array([[(h * x * x).sum() + pull, (h * x).sum()], [(h * x).sum(), h.sum() + pull]])
        step = np.linalg.solve(m, g)
        a, b = max(0.1, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _sample(df: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, text, label) of the rows of at most `most` labelled ids of the training fold, those that hash lowest."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).alias("label"))
    known = known.where(F.crc32(F.col("lid").cast("string").cast("binary")) % 5 != 0).withColumn("h", F.shiftrightunsigned(F.xxhash64("lid"), 24))
    # rows are let through by their hash first, so that sorting sees about 1.5 * most of them at any size
    share = 1.5 * (most + 100) / max(1, known.count())
    chosen = known.where(F.col("h") < int(min(1.0, share) * 2**40)).orderBy("h", "lid").limit(most)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("lid")).select("id", "text", F.col("label").cast("int").alias("label"))


def telling(a: np.ndarray, n: np.ndarray, positive: int, rows: int) -> np.ndarray:
    """From FLOOR to 1: how far a word in n of the rows, a of them positive, tells the labels apart.

    A smooth step over the log-likelihood ratio of its two by two table of occurrence and label.
    """
    ratio = np.zeros(len(n))
    for seen, toxic in ((n, a), (rows - n, positive - a)):
        for count, share in ((toxic, positive / rows), (seen - toxic, 1 - positive / rows)):
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio += np.where(count > 0, 2 * count * np.log(count / (seen * share)), 0.0)
    return FLOOR + (1 - FLOOR) / (1 + np.exp(-(ratio - TELLING) / 2))


def _words(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """The words of the sample (text, label, last), and of each its positive and all rows, then those without `last`.

    Near copies share their rare words by chance: one text for each least shingle, by two hashes, counts, so words that
    only others have come with zeros. The empty word stands for all rows.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_least_shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text", "label", "last")), *(pa.array([g[i] for g in got], pa.string()) for i in (0, 1))], ["text", "label", "last", "s0", "s1"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in range(4))], ["word", *names])
            found.clear()
            return out

        for batch in batches:
            for text, *flags in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("label", "last", "once")), strict=True):
                label, last, once = flags
                add = [once * label, once, once * label * (not last), once * (not last)]
                for w in {"", *tokens(text.as_py())}:
                    c = found.setdefault(w, [0, 0, 0, 0])
                    for i in range(4 if once else 0):
                        c[i] += add[i]
                if len(found) > 200_000:
                    yield flush()
        yield flush()

    names = ["positive", "total", "first_positive", "first_total"]
    kept = sample.select("text", "label", "last").mapInArrow(lean(sketches), "text string, label int, last boolean, s0 string, s1 string")
    for s in ("s0", "s1"):
        kept = kept.groupBy(s).agg(F.max(F.struct("label", "text", "last", "s1")).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in ("text", "label", "last", "s1")])
    every = kept.select("text", "label", "last", F.lit(1).alias("once")).union(sample.select("text", "label", "last", F.lit(0)))
    counted = every.mapInArrow(lean(words), "word string, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    by = np.argsort(np.array(counted.column("word").to_pylist(), object), kind="stable") if counted.num_rows else np.zeros(0, np.int64)
    counted = counted.take(pa.array(by))
    return counted.column("word").to_pylist(), np.stack([counted.column(n).to_numpy() for n in names], axis=1)


def _frequencies(df: DataFrame, text_col: str, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many rows of the whole table each term occurs, and the number of rows."""
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            seen[-1] += batch.num_rows
            for text in batch.column("text"):
                words = set(tokens(text.as_py()))
                places = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                seen[places[places >= 0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["term", "n"])

    every = df.select(F.col(f"`{text_col}`").alias("text"))
    found = every.mapInArrow(lean(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    shared.destroy()
    return out[:-1], int(out[-1])


def _vectors(sample: DataFrame, terms: dict[str, int]) -> pa.Table:
    """The different texts of the sample as (terms, counts), with their positive and all rows and an id, then those without `last`."""
    blank = Model(terms, np.zeros(0), 0.0)
    shared = sample.sparkSession.sparkContext.broadcast(blank)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)), batch.column("label").cast(pa.int32()), batch.column("last"), batch.column("id")], ["terms", "counts", "label", "last", "id"])

    vectors = sample.select("text", "label", "last", F.col("id").cast("string").alias("id")).mapInArrow(lean(examples), "terms array<int>, counts array<int>, label int, last boolean, id string")
    first = lambda c: F.when(~F.col("last"), c)
    sums = [F.sum("label").alias("a"), F.count("*").alias("n"), F.min("id").alias("id"), F.coalesce(F.sum(first(F.col("label"))), F.lit(0)).alias("first_a"), F.count(first(F.lit(1))).alias("first_n"), F.min(first(F.col("id"))).alias("first_id")]
    out = vectors.groupBy("terms", "counts").agg(*sums).toArrow().combine_chunks()
    shared.destroy()
    return out


def _indexed(vectors: pa.Table, prefix: str, terms: dict[str, int], idf: np.ndarray, n: np.ndarray, rows: int, k: int) -> Model:
    """A model of the sample's texts (prefix `first_`: of those without `last`), not yet calibrated. idf: by term."""
    model = Model(terms, idf, (math.log(rows + 1) + 1) * FLOOR, k=k)
    lists = vectors.column("terms").combine_chunks()
    start = lists.offsets.to_numpy()
    flat, counts = lists.values.to_numpy().astype(np.int64), vectors.column("counts").combine_chunks().values.to_numpy()
    positive, total = (vectors.column(f"{prefix}{c}").to_numpy().astype(float) for c in ("a", "n"))
    model.prior = (positive.sum() + 1) / (total.sum() + 2)
    bare = np.flatnonzero((start[1:] == start[:-1]) & (total > 0))
    model.bare = (positive[bare[0]] + model.prior) / (total[bare[0]] + 1) if len(bare) else model.prior
    kept, none = [], np.zeros(0, np.int64)
    for r in np.flatnonzero((start[1:] > start[:-1]) & (total > 0)):
        t, c = flat[start[r] : start[r + 1]], counts[start[r] : start[r + 1]]
        w = model.vector(t, c, none)
        # texts with the same telling word, or else with the same commonest word, share blocks: bounds differ more
        at = np.argmax(w) if w.max() > 0.3 else np.argmax(n[t])
        kept.append((int(t[at]), t.tobytes(), c.tobytes(), t, w, int(r)))
    kept.sort(key=lambda x: x[:3])
    of = [x[-1] for x in kept]
    shrink = 1 / np.sqrt(np.maximum(total[of], 1))  # copies of one text agree anyway: n of them vote as its square root
    model.positive, model.total = positive[of] * shrink, total[of] * shrink
    model.index, model.names = BlockMaxIndex([x[3:5] for x in kept], len(terms)), vectors.column(f"{prefix}id").take(pa.array(of, pa.int64())).to_pylist()
    return model


def fit(df: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", k: int = 15, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most max_labelled labelled ids whose crc32(id as text) mod 5 is not 0.

    All words of the sample's texts are terms, with their document frequency over the whole table and the share of it
    that `telling` gives them. Examples are the sample's texts of either label as unit vectors of all their words, equal
    vectors merged. A first model of four fifths of the sample scores the last fifth, to which the curve that turns
    votes into scores is fitted; the model returned has all of the sample. An id with several labels has the largest;
    all rows of an id with several texts are examples. Without labels of both kinds nothing can be told apart: the model
    has no examples and scores every text 0.
    """
    stage = Staging(df.sparkSession)
    try:
        last = F.pmod(F.xxhash64(F.lit(7), F.col("text")), F.lit(5)) == 0
        sample = stage.table(_sample(df, labels, text_col, id_col, label_col, max_labelled).withColumn("last", last))
        words, counts = _words(sample)
        once = counts[0] if words and words[0] == "" else np.zeros(4, np.int64)
        if not 0 < once[0] < once[1]:
            return Model({}, np.zeros(0), 0.0)
        words, counts = words[1:], counts[1:]
        # entered by how often they occur: what most look-ups need lies together in memory, here and in the workers
        terms = {words[i]: i for i in np.argsort(-counts[:, 1], kind="stable").tolist()}
        n, rows = _frequencies(df, text_col, terms)
        vectors = _vectors(sample, terms)
        idf = np.log((rows + 1) / (n + 1)) + 1
        held = []
        if 0 < once[2] < once[3]:
            first = _indexed(vectors, "first_", terms, idf * telling(counts[:, 2], counts[:, 3], once[2], once[3]), n, rows, k)
            shared = df.sparkSession.sparkContext.broadcast(first)
            del first

            def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                m = shared.value
                for batch in batches:
                    near = list(m.near(batch.column("text").to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array([m.vote(x) if x else None for x in near], pa.float64()), batch.column("label").cast(pa.int32())], ["share", "label"])

            held = sample.where("last").select("text", "label").mapInArrow(lean(votes), "share double, label int").where("share is not null").collect()
            shared.destroy()
        model = _indexed(vectors, "", terms, idf * telling(counts[:, 0], counts[:, 1], once[0], once[1]), n, rows, k)
    finally:
        stage.close()
    if held:
        model.slope, model.offset = _platt(np.array([r["share"] for r in held]), np.array([float(r["label"]) for r in held]), np.ones(len(held)))
    return model


def score(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """(row struct, score double, evidence array<struct<id string, cosine double>>) of every row.

    One pass, no shuffle: each task holds the broadcast model, whose size `max_labelled` bounds. Whole texts are scored;
    a null text counts as an empty one, and texts without any word of an example get the share of label 1 among such
    examples, pulled to that of all. Repeated rows fare alike. Columns of df stay inside row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    held = packed(df).select("row", F.col(f"row.`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = m.scores(batch.column("text").to_pylist())
            evidence = pa.array([[{"id": m.names[i], "cosine": c} for c, i in near] for _, near in got], pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([s for s, _ in got], pa.float64()), evidence], ["row", "score", "evidence"])

    kind = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(lean(run), f"row {kind}, score double, evidence array<struct<id:string,cosine:double>>")


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    ident = F.col("row.doc_id")
    held_out = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(ident.alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
