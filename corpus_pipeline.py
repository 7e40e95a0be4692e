"""A corpus pipeline over documents: stages that each apply one operator of orrery.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, minhash, mixing, suffixes, toxicity
from orrery.llm.common import Staging, delete_at_exit

#: The mix takes this share of all words, no document more than once.
MIX_SHARE, MIX_REPEATS, MIX_WEIGHTS = 0.8, 1.0, (5, 2, 1)
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from the labelled ones outside the held-out fold.

    Without labels of both kinds every score is 0 and all documents stay. Null and empty texts are scored like others;
    repeated rows fare alike; an empty table gives an empty one.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id; of rows that repeat its id and text, one."""
    kept = minhash.near_dedup(docs).where("kept").select("row.*")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    twice = kept.groupBy("doc_id", key.alias("k")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("d"), "k")
    if twice.isEmpty():
        return kept
    again = F.col("doc_id").eqNullSafe(F.col("d")) & (key == F.col("k"))
    return kept.join(twice, again, "left_anti").union(kept.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that another one keeps; those that lose all their words go."""
    out = suffixes.dedup(docs).where((F.col("n_removed") == 0) | (F.col("clean_text") != ""))
    gone = F.col("n_removed") > 0
    changed = {"text": F.when(gone, F.col("clean_text")).otherwise(F.col("row.text")), "n_chars": F.when(gone, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it; those without words as often as their source's.

    A null source is a source of its own; repeated rows (same id and text) are taken or left together.
    """
    out = mixing.mix(docs, weights=MIX_WEIGHTS, share=MIX_SHARE, most_repeats=MIX_REPEATS)
    return out.where("repeats > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, their number and a digest of what they decode to; null and empty texts have no ids."""
    path = public_tokenizers.path(TOKENIZER)
    out = bpe.round_trip(docs, path, keep=["doc_id", "source"])
    return out.select("row.*", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("source_mix", mix_sources), ("bpe", tokenize)]

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other, each reading what the one before has written."""
    docs, stage, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), Staging(spark), None
    for n, (_, apply) in enumerate(STAGES):
        out = apply(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            delete_at_exit(spark, stage.root)  # the result still reads the last table
            return out
        docs, last = stage.table(out), held
        held = docs
        if last is not None:
            stage.drop(last)
    return docs
