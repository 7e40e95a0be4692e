"""How the operators do their work, where results alone would not tell."""

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from orrery.llm import common, minhash, suffixes


def test_repeats_meet_their_texts_by_one_plan(spark, monkeypatch):
    """Texts and places are joined alike at any size, and a passage over many ranges is settled without a join."""
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 10)
    joins, join = [], suffixes.join_small
    monkeypatch.setattr(suffixes, "join_small", lambda left, right, *a, **more: (joins.append((left.columns, right.columns)), join(left, right, *a, **more))[1])
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{' '.join(f'a{n}x{i}' for i in range(20))} {passage} {' '.join(f'b{n}x{i}' for i in range(20))}" for n in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks, _ = suffixes.repeats(df)
    found = marks.select("first", F.explode("spans").alias("s")).select("first", "s.*").collect()
    assert sorted((r["first"], r["start"], r["words"]) for r in found) == [(n, 20, 60) for n in range(12)]
    assert len({r["keeper"] for r in found}) == 1 and sum(r["removed"] for r in found) == 11
    assert not any("places" in right or "keeper" in right or "least" in right for _, right in joins)


def test_buckets_are_told_by_one_exchange(spark, monkeypatch):
    """No row is looked up by its bucket: what a bucket holds is told where its rows are dealt to, copies of a row once."""
    monkeypatch.setattr(minhash, "join_small", lambda left, right, on, *a, **more: pytest.fail("joined by bucket") if isinstance(on, str) and on == "bucket" else common.join_small(left, right, on, *a, **more))
    rows = [(b, k, 10, b) for b in range(4) for k in range(b * 3, b * 3 + 2 + 10 * b)]
    class_of = {k: 0 if k < 6 else k // 20 * 20 for _, k, _, _ in rows}
    stage = common.Staging(spark)
    try:
        members = spark.createDataFrame(rows, "bucket long, key long, n long, lead long")
        roots = spark.createDataFrame([(k, r) for k, r in class_of.items() if r != k], "node long, root long")
        opened = minhash._open(stage, members, roots)
        keys = {b: [k for c, k, _, _ in rows if c == b] for b in range(4)}
        sizes = {b: len(ks) for b, ks in keys.items() if len({class_of[k] for k in ks}) > 1}
        assert sorted(map(tuple, opened.collect())) == sorted((b, k, n, class_of[k], sizes[b]) for b, k, n, _ in rows if b in sizes)
        assert 0 < len(sizes) < 4
        true = {(a, k) for b in sizes for a in keys[b] for k in keys[b] if a < k and class_of[a] != class_of[k]}
        assert {(r["a"], r["b"]) for r in minhash._across(stage, opened.drop("size"), 0.8).collect()} == true
    finally:
        stage.close()


def test_workers_give_memory_back():
    """What a function of mapInArrow has freed is the system's again when the task ends, whether it ended or was stopped."""

    def run(batches):
        kept = []
        for n in batches:
            pieces = [np.ones(8_000) for _ in range(n)]  # 64 KB each
            kept.append(np.ones(8_000))  # above them, so that they stay with the process
            del pieces
            yield psutil.Process().memory_info().rss
        held.extend(kept)

    for stopped in (False, True):
        held: list = []
        tasks = common.lean(run)(iter([3_000, 1]))
        before = next(tasks)
        tasks.close() if stopped else list(tasks)
        assert before - psutil.Process().memory_info().rss > 100e6
