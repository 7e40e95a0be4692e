"""What near copies keep on disk."""

from orrery.llm import minhash
from orrery.llm.common import Staging


def test_sketches_are_dealt_out_once(spark, monkeypatch):
    """All sketches were written to disk, and then shuffled twice to find the buckets of more than one text."""
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join([*words[40 * (i % 6) : 40 * (i % 6) + 50], *(["more"] * (i // 6))])) for i in range(12)], "doc_id long, text string")
    kept, table = [], Staging.table
    monkeypatch.setattr(Staging, "table", lambda stage, t, *more: (kept.append(set(t.columns)), table(stage, t, *more))[1])
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_dedup(df).select("row.doc_id", "class_id").collect()}
    assert found == {i: i % 6 for i in range(12)}
    assert {"bucket", "key", "n"} not in kept and {"bucket", "key", "n", "lead"} in kept
