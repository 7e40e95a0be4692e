"""The index of labelled examples."""

import numpy as np

from orrery.llm.toxicity import BlockMaxIndex, Model


def test_common_terms_are_rows():
    """Terms of nearly all examples leave the postings, and the nearest examples stay the same."""
    r = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        ids = np.concatenate([np.arange(20), np.sort(r.choice(np.arange(20, 3000), 10, replace=False))])
        w = r.uniform(0.01, 1, 30)
        vectors.append((ids, w / np.linalg.norm(w)))
    index = BlockMaxIndex(vectors, 3000)
    assert len(index.weights) <= 700 * 10
    dense = np.zeros((700, 3000))
    for row, (ids, w) in zip(dense, vectors, strict=True):
        row[ids] = w
    for ids, w in vectors[:50]:
        got = index.nearest(ids, w, 5)
        want = dense[:, ids] @ w
        best = np.lexsort((np.arange(700), -want))[:5]
        assert [n for _, n in got] == best.tolist() and np.allclose([c for c, _ in got], want[best])


def test_a_text_does_not_depend_on_the_others():
    """Texts are compared with the common terms many at a time: the products are exact, and those of a text the same in any place."""
    r = np.random.default_rng(6)
    made = [np.sort(r.choice(400, 60, replace=False)) for _ in range(300)]
    vectors = [(ids, r.uniform(0.01, 1, 60)) for ids in made]
    index = BlockMaxIndex(vectors, 400, width=32)
    assert len(index.rows) > 100
    model = Model({f"w{i}": i for i in range(400)}, r.uniform(0.1, 1, 400), 0.1, index, k=9)
    texts = [" ".join(f"w{i}" for i in r.choice(500, 80)) for _ in range(150)]
    texts[5] = texts[69] = texts[149] = texts[0]
    texts[7] = None
    texts[8] = "unknown"
    got = list(model.near(texts))
    assert got[0] == got[5] == got[69] == got[149] == next(model.near(texts[:1])) and got[7] == got[8] == []
    for text, found in zip(texts, got, strict=True):
        ids, counts, others = model.counts(text)
        w = model.vector(ids, counts, others)
        want = np.array([sum(v[np.searchsorted(i, ids[np.isin(ids, i)])] * w[np.isin(ids, i)]) for i, v in vectors])
        best = np.lexsort((np.arange(300), -want))[: len(found)]
        assert [n for _, n in found] == best.tolist() and np.allclose([c for c, _ in found], want[best])
