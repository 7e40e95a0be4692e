"""Near copies of embeddings by a robust-pruned flat graph: shards, united adjacency, range-expanding greedy search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, components, cut, different_texts, join_small

COSINE = 0.95
#: Rows the centroids are fitted on at most (those whose vectors hash lowest), and vectors a shard should hold.
FIT_ROWS, SHARD_ROWS = 20_000, 1_000
#: Clusters each vector belongs to, and clusters it is searched in: its nearest ones.
OVERLAP, VISITS = 2, 3
#: Edges of a vector after pruning in a shard, and the pruning's slack.
DEGREE, ALPHA = 20, 1.2
#: A search goes on through vectors within this cosine of the query although only those at COSINE or above count.
EXPAND = 0.80


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1: scaled by their largest component first, whose square might be too large or too small a number."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the rows that a farthest-first walk picks."""
    k = max(1, min(k, len(sample)))
    chosen, best = [0], sample @ sample[0]
    for _ in range(k - 1):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    c = sample[chosen].copy()
    for _ in range(rounds):
        of = (sample @ c.T).argmax(axis=1)
        for j in range(k):
            total = sample[of == j].sum(axis=0)
            if (size := np.sqrt(total @ total)) > 0:
                c[j] = total / size
    return c


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each row of a shard after robust pruning, and the reverse edges.

    Candidates are a row's nearest rows of the shard; going from the nearest on, a candidate stays unless a kept one
    is, by the slack alpha, nearer to it than the row itself is (the public Vamana rule). A few random edges per row,
    as that rule starts from, keep tight groups reachable.
    """
    n = len(x)
    pool = min(n - 1, 3 * degree)
    if pool <= 0:
        return [np.zeros(0, np.int64) for _ in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, 512):
        cos = x[at : at + 512] @ x.T
        cos[np.arange(len(cos)), np.arange(at, at + len(cos))] = -2
        near = np.argpartition(-cos, pool - 1, axis=1)[:, :pool]
        for i, row in enumerate(near):
            row = row[np.argsort(-cos[i, row], kind="stable")]
            far = np.sqrt(np.maximum(0, 2 - 2 * cos[i, row]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[row] @ x[row].T)))
            open_ = np.ones(len(row), bool)
            while open_.any() and len(out[at + i]) < degree:
                p = int(open_.argmax())
                out[at + i].append(int(row[p]))
                open_ &= alpha * between[p] > far
                open_[p] = False
    links = [set(o) for o in out]
    for i, far in enumerate(np.random.default_rng(n).integers(0, n, (n, 3)).tolist()):
        links[i].update(j for j in far if j != i)
    for i, o in enumerate(out):
        for j in o:
            links[j].add(i)
    return [np.array(sorted(s), np.int64) for s in links]


def range_search(q: np.ndarray, x: np.ndarray, graph: list[np.ndarray], start: int, least: float, expand: float = EXPAND, width: int = 16) -> np.ndarray:
    """Rows of x with cosine >= least to q: a greedy walk from start to the nearest rows, then outward while rows are in range.

    The walk opens rows, a few at a time, until the `width` best seen are open; every row within `expand` is opened as
    well, however many there are, so the answer has no cap.
    """
    score = np.full(len(x), -np.inf)
    score[start] = x[start] @ q
    opened = np.zeros(len(x), bool)
    seen = np.array([start])
    while True:
        best = seen[np.argpartition(-score[seen], width)[:width]] if len(seen) > width else seen
        best = best[~opened[best]]
        within = seen[(score[seen] >= expand) & ~opened[seen]]
        todo = within if len(within) else best[np.argsort(-score[best], kind="stable")][:6]
        if not len(todo):
            return seen[score[seen] >= least]
        opened[todo] = True
        near = np.concatenate([graph[i] for i in todo])
        new = np.unique(near[score[near] == -np.inf])
        score[new] = x[new] @ q
        seen = np.concatenate([seen, new])


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double> or null): null where a vector cannot link with anything."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))


class _Sets:
    """Disjoint sets of the numbers 0 .. n - 1, each named by its first."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.of[max(i, j)] = min(i, j)


def search_piece(shard: int, keys: np.ndarray, copies: np.ndarray, x: np.ndarray, visits: np.ndarray, lists: list, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece of a shard, searched for all rows of x: (key, others, root) with one row per key that has a link here.

    lists: the united adjacency list (keys) of the piece's own members, None for rows that only search here. others:
    copies of the linked vectors counted here. A pair that meets in several shards counts in the first shard of the
    found vector that the searching one visits; the found vector counts it from here too if it visits none of the
    searching one's. root: the least key of those that the links found here connect.
    """
    own = np.array([i for i, of in enumerate(lists) if of is not None], np.int64)
    base = x[own]
    if not len(own):
        return keys[:0], copies[:0], keys[:0]
    place = {k: i for i, k in enumerate(keys[own].tolist())}
    graph = [np.array([place[k] for k in lists[i] if k in place], np.int64) for i in own]
    medoid = int((base @ base.mean(axis=0)).argmax())
    others = np.zeros(len(keys), np.int64)
    sets = _Sets(len(keys))
    linked = np.zeros(len(keys), bool)
    for i in range(len(keys)):
        found = own[range_search(x[i], base, graph, medoid, cosine)]
        found = found[keys[found] != keys[i]]
        if not len(found):
            continue
        linked[i] = linked[found] = True
        for j in found:
            sets.join(i, int(j))
        first = visits[found, 0]
        here = found[(first == shard) | ~np.isin(first, visits[i])]
        others[i] += copies[here].sum()
        back = here[~np.isin(visits[here], visits[i, :OVERLAP]).any(axis=1)]
        others[back] += copies[i]
    at = np.flatnonzero(linked)
    groups: dict[int, int] = {}
    for i in at:
        r = sets.root(int(i))
        groups[r] = min(groups.get(r, keys[i]), keys[i])
    return keys[at], others[at], np.array([groups[sets.root(int(i))] for i in at], np.int64)


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n_links long, component_id) of every row.

    Equal vectors are merged; their number counts as links of each other. Centroids are fitted on a bounded sample;
    every vector is a member of the shards of its OVERLAP nearest clusters and is searched in those of its VISITS
    nearest. A shard that is too large is cut by hash into pieces of about shard_rows members, so no task holds a whole
    hot shard. Each piece is built into a robust-pruned graph; the lists that a vector gets in its pieces are united, by
    hash aggregation, into one adjacency list. The united graph is then searched piece by piece for all the shard's
    visitors: a walk from the piece's medoid follows united lists as far as they lead within the piece. A search yields
    sums of copies and the edges of a spanning star, never all pairs. Whatever is counted has been verified by cosine
    in double precision, for components of any size that a double has.

    A clump of m different vectors that are all within EXPAND of each other costs m * m cosines, as their links have to
    be counted, in pieces of shard_rows, with a copy of every visitor for each.

    Equal cosines make no ties, as nothing is ranked beyond the shards a vector goes to: the first centroid of equals.
    Null, empty and zero vectors and those with null, NaN or infinite components have no links and are their own
    component; vectors of different lengths never link. Rows that repeat an id count as vectors of their own. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    stage = Staging(spark)
    rows = _vectors(df, id_col, vector_col)
    try:
        found, key_of = different_texts(stage, rows.where("v is not null").select("id", F.col("v").alias("text")))
        held = rows.where("v is not null").withColumn("key", key_of(F.col("v")))
        same = stage.table(held.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.min("v").alias("v")))
        shared = spark.sparkContext.broadcast(fit_clusters(same, shard_rows))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list[int]] = []
                for v in batch.column("v").to_pylist():
                    c = shared.value.get(len(v))
                    near = np.argsort(-(c @ unit_rows(np.array([v]))[0]), kind="stable")[:VISITS].tolist() if c is not None else [0]
                    near += [near[-1]] * (VISITS - len(near))
                    out.append([len(v) << 32 | j for j in near])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "copies", "v")), pa.array(out, pa.list_(pa.int64()))], ["key", "copies", "v", "visits"])

        placed = stage.table(same.select("key", "copies", "v").mapInArrow(assign, "key long, copies long, v array<double>, visits array<long>"))
        members = placed.select("key", F.explode(F.array_distinct(F.slice("visits", 1, OVERLAP))).alias("shard"))
        pieces = stage.table(members.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(float(shard_rows))).cast("int").alias("pieces")))
        dealt = join_small(placed.withColumn("shard", F.explode(F.array_distinct("visits"))), pieces, "shard")
        piece = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        own = F.pmod(F.xxhash64("key", "shard"), F.col("pieces")).cast("int")
        belongs = F.array_contains(F.slice("visits", 1, OVERLAP), F.col("shard"))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = pdf["key"].to_numpy()
            graph = build_graph(unit_rows(np.stack(pdf["v"].to_numpy())))
            return pd.DataFrame({"key": keys, "near": [keys[near].tolist() for near in graph]})

        built = dealt.where(belongs).select("shard", own.alias("piece"), "key", "v").groupBy("shard", "piece").applyInPandas(build, "key long, near array<long>")
        graph = stage.table(built.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).withColumnRenamed("key", "g"))
        listed = placed.join(graph, F.col("key") == F.col("g")).drop("g")
        dealt = join_small(listed.withColumn("shard", F.explode(F.array_distinct("visits"))), pieces, "shard")
        dealt = dealt.select("shard", piece.alias("piece"), "key", "copies", "v", "visits", own.alias("own"), F.when(belongs, F.col("near")).alias("near"))
        dealt = dealt.withColumn("near", F.when(F.col("own") == F.col("piece"), F.col("near"))).drop("own")

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            x = unit_rows(np.stack(pdf["v"].to_numpy()))
            found = search_piece(int(pdf["shard"].iloc[0]), pdf["key"].to_numpy(), pdf["copies"].to_numpy(), x, np.stack(pdf["visits"].to_numpy()), list(pdf["near"]), cosine)
            return pd.DataFrame(dict(zip(("key", "others", "root"), found, strict=True)))

        found = stage.table(dealt.groupBy("shard", "piece").applyInPandas(search, "key long, others long, root long"))
        linked = found.groupBy("key").agg(F.sum("others").alias("others"))
        roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
        classed = same.select("key", "copies", "first").join(linked, "key", "left").join(roots, F.col("key") == F.col("node"), "left").select("key", "copies", "first", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "key").alias("root"))
        classed = stage.table(classed)
        least = classed.groupBy("root").agg(F.min("first").alias("component"))
        keyed = cut(classed.join(least, "root").select(F.col("key").alias("k"), (F.col("copies") - 1 + F.col("others")).alias("links"), "component"))
    finally:
        stage.close()
    named = rows.select("id", F.when(F.col("v").isNotNull(), key_of(F.col("v"))).alias("key"))
    out = named.join(keyed, F.col("key") == F.col("k"), "left")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def fit_clusters(same: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, fitted on the FIT_ROWS vectors of least key: one for about shard_rows members."""
    n = same.count()
    # keys are hashes: a bound on them lets about 1.2 * FIT_ROWS rows through to the sort, at any size
    share = min(1.0, 1.2 * (FIT_ROWS + 100) / max(n, 1))
    sample = [r["v"] for r in same.where(F.shiftrightunsigned("key", 24) < int(share * 2**40)).orderBy("key").limit(FIT_ROWS).select("v").collect()]
    out = {}
    for d in sorted({len(v) for v in sample}):
        x = unit_rows(np.array([v for v in sample if len(v) == d]))
        out[d] = centroids(x, -(-n * len(x) * OVERLAP // (len(sample) * shard_rows)))
    return out


def audit_recall(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, queries: int = 200, shard_rows: int = SHARD_ROWS) -> tuple[float, int]:
    """Share of the links of a fixed sample of vectors (least hashes) that near_vectors has, and their true number.

    The true links are counted by brute force, in one pass over all vectors. Without any the share is NaN.
    """
    rows = _vectors(df, id_col, vector_col).where("v is not null")
    sample = rows.orderBy(F.xxhash64("v"), "id").limit(queries).collect()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast([(len(r["v"]), unit_rows(np.array([r["v"]]))[0]) for r in sample])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.zeros(len(shared.value), np.int64)
            for v in batch.column("v").to_pylist():
                x = unit_rows(np.array([v]))[0]
                got += [n == len(x) and q @ x >= cosine for n, q in shared.value]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got)), pa.int64()), pa.array(got, pa.int64())], ["q", "n"])

    true = {r["q"]: r["n"] - 1 for r in rows.select("v").mapInArrow(count, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()}
    ids = [r["id"] for r in sample]
    have = {r["id"]: r["n_links"] for r in near_vectors(df, id_col=id_col, vector_col=vector_col, cosine=cosine, shard_rows=shard_rows).where(F.col("id").isin(ids)).collect()}
    total = sum(true.values())
    return (sum(min(have[i], true[n]) for n, i in enumerate(ids)) / total if total else float("nan")), total


def op2_query(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
