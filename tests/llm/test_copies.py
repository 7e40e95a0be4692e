"""Near copies, repeats, vectors, toxicity, licences and the pipeline."""

import os
import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import common, licenses, minhash, suffixes, toxicity, vectors
from tests.llm.conftest import PASSAGE, words


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(1)
    for n in range(1500):
        a = [r.randrange(4 if n % 3 else 40) for _ in range(r.randrange(20 if n % 5 else 90))]
        b = [r.randrange(4) for _ in range(r.randrange(20))] if n % 2 else [x if r.random() > 0.2 else -1 for x in a if r.random() > 0.1]
        most, true = r.randrange(12 if n % 5 else 60), plain_distance(a, b)
        assert minhash.banded_distance(a, b, most) == min(true, most + 1)


def test_sketches():
    h = common.WordHashes()
    a = h.of(words(1, 300).split())
    assert (minhash.order_sketches(a) == minhash.order_sketches(a.copy())).all()
    moved = np.concatenate([a[150:], a[:150]])  # the same k-mers but for a few, in another order
    b = a.copy()
    b[150] += np.uint64(1)
    same = lambda x: (minhash.order_sketches(a) == minhash.order_sketches(x)).sum()
    assert same(b) > same(moved) and same(h.of(words(2, 300).split())) == 0
    for n in range(70):
        assert 1 <= len(minhash.order_sketches(a[:n])) <= 2 * minhash.SKETCHES


def edited(r, a, changes):
    """a with that many words replaced, taken out or joined by another one, at random places."""
    out = [[w] for w in a]
    for p in r.sample(range(len(a)), changes):
        out[p] = r.choice([[f"new{r.random()}"], [], [*out[p], f"new{r.random()}"]])
    return [w for x in out for w in x]


@pytest.mark.parametrize("n", [8, 30, 60, 70, 100, 300, 1000])
def test_recall_at_the_threshold(n):
    """Of pairs as unlike as a link allows, nine in ten and more agree in a sketch."""
    r, h, found = random.Random(n), common.WordHashes(), []
    while len(found) < 120:
        a = words(r.random(), n).split()
        b = edited(r, a, int(0.2 * n))
        if minhash.similar(a, b):
            found.append(bool(set(minhash.order_sketches(h.of(a)).tolist()) & set(minhash.order_sketches(h.of(b)).tolist())))
    assert np.mean(found) >= 0.93


def classes(rows):
    """Classes by brute force over all pairs."""
    n, of = len(rows), list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    seq = [(t or "").split() for _, t in rows]
    for i in range(n):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or minhash.similar(seq[i], seq[j]):
                of[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(n):
        groups[root(i)].append(rows[i][0])
    return {i: min((x for x in groups[root(i)] if x is not None), default=None) for i in range(n)}


def test_near_dedup(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((rows[i][0], c) for i, c in classes(rows).items())
    got = minhash.near_dedup(docs).select("row.doc_id", "class_id", "kept").collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert minhash.near_dedup(empty).count() == 0


def test_large_buckets(spark):
    r = random.Random(3)
    base, out = words(1, 120).split(), []
    for i in range(60):  # one large class
        copy = list(base)
        copy[r.randrange(120)] = f"edit{i}"
        out.append(" ".join(copy))
    out += [f"{PASSAGE} {words(500 + i, 25)}" for i in range(60)]  # a passage in common, no more
    df = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash.near_dedup(df).select("row.doc_id", "class_id").collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == i for i in range(60, 120))


def linked(texts):
    """Which pairs are similar and agree in a sketch."""
    h = common.WordHashes()
    seq = [t.split() for t in texts]
    held = defaultdict(set)
    for i, x in enumerate(seq):
        for y in minhash.order_sketches(h.of(x)):
            held[y].add(i)
    pairs = {(i, j) for v in held.values() for i in v for j in v if i < j}
    return {(i, j) for i, j in pairs if minhash.similar(seq[i], seq[j])}, seq


def near_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x.doc_id: x.class_id for x in minhash.near_dedup(df).select("row.doc_id", "class_id").collect()}


def test_master_and_copies(spark):
    r = random.Random(9)
    base, out = words(1, 300).split(), []
    for i in range(400):  # each is like the master, few like each other
        copy = list(base)
        for p in range(2):
            at = r.randrange(275)
            copy[at : at + 24] = [f"e{i}x{p}y{k}" for k in range(24)]
        out.append(" ".join(copy))
    out.append(" ".join(base))
    pairs, _ = linked(out)
    got = near_ids(spark, out)
    assert len(pairs) > 350 and [(i, j) for i, j in pairs if got[i] != got[j]] == []


def test_template_in_pairs(spark):
    r = random.Random(10)
    base, out = words(2, 200).split(), []
    for i in range(200):  # texts of one template that are unlike each other but for their twins
        copy = list(base)
        for n, at in enumerate(r.sample(range(0, 200, 20), 5)):
            copy[at : at + 14] = [f"t{i}x{n}y{k}" for k in range(14)]
        own = [k for k, w in enumerate(copy) if w != base[k]]
        twin = list(copy)
        for k in [*own[2::5], *r.sample(range(200), 12)]:
            twin[k] = f"twin{i}x{k}"
        out += [" ".join(copy), " ".join(twin)]
    pairs, seq = linked(out)
    got = near_ids(spark, out)
    assert len(pairs) > 50 and [(i, j) for i, j in pairs if got[i] != got[j]] == []
    assert all(minhash.similar(seq[i], seq[i + 1]) or got[i] != got[i + 1] for i in range(0, 400, 2))


def test_prefix_grams():
    r, n = random.Random(11), 0
    counts = np.random.default_rng(1).integers(0, 9, minhash.BINS)
    h = common.WordHashes()
    for _ in range(4000):
        a = [f"v{r.randrange(12)}" for _ in range(r.randrange(40))]
        b = [x for x in (y if r.random() > 0.1 else f"v{r.randrange(12)}" for y in a) if r.random() > 0.05]
        x, y = h.of(a), h.of(b)
        if minhash.similar(a, b):
            n += 1
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            only = [sum((p & ~q & (2**64 - 1)).bit_count() for p, q in zip(*map(lambda w: minhash.word_marks(w).tolist(), z), strict=True)) for z in ((x, y), (y, x))]
            assert max(only) <= most
            assert set(minhash.prefix_grams(x, 0.8, counts).tolist()) & set(minhash.prefix_grams(y, 0.8, counts).tolist())
    assert n > 1000


def test_rare_words_part_families(spark):
    """Texts of one template: only few pairs of them share a rare word, and no link is lost."""
    r, out = random.Random(12), []
    template = words(3, 300).split()
    for i in range(40):  # a family
        copy = [*template, *words(4, 100).split()]
        copy[300 + 2 * i : 302 + 2 * i] = [f"own{i}", f"own{i}"]
        out.append(copy)
    for i in range(40):  # and texts that have the template and an end of their own, some of them in pairs
        out.append([*template, *words(50 + i // 2 if i < 10 else 900 + i, 100).split()])
        out[-1][r.randrange(300)] = f"changed{i}"
    texts = [" ".join(x) for x in out]
    pairs, seq = linked(texts)
    stage = common.Staging(spark)
    rows = [(i, 0 if i < 40 else i, len(x), t) for i, (x, t) in enumerate(zip(seq, texts, strict=True))]
    df = spark.createDataFrame(rows, "key long, root long, n long, text string")
    placed = minhash._split(stage, df.select("key", "root"), df.select("key", "text", "n"), 0.8)
    met = {(x.a, x.b) for x in minhash._across(stage, placed, 0.8).collect()}
    stage.close()
    across = {(i, j) for i, j in pairs if rows[i][1] != rows[j][1]}
    assert len(across) >= 5 and across <= met and len(met) < 600  # of 2380 pairs in all
    got = near_ids(spark, texts)
    assert [(i, j) for i, j in pairs if got[i] != got[j]] == []


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7)]
    of = {}

    def root(i):
        of.setdefault(i, i)
        while of[i] != i:
            i = of[i]
        return i

    for a, b in edges:
        if a != b:
            of[max(root(a), root(b))] = min(root(a), root(b))
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in of}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def covered(rows, n):
    holders = defaultdict(set)
    split = {i: (t or "").split() for i, t in rows}
    for i, t in rows:
        w = split[i]
        for a in range(len(w) - n + 1):
            holders[tuple(w[a : a + n])].add(i)
    out = defaultdict(set)
    for i, w in split.items():
        for a in range(len(w) - n + 1):
            if len(holders[tuple(w[a : a + n])]) > 1:
                out[i].update(range(a, a + n))
    return out


def test_repeats(spark, docs, empty):
    clean = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    once = {}
    for i, t in sorted(rows):
        once.setdefault(t, i)
    marks = suffixes.repeats(clean, min_words=50)[0].collect()
    got = {m.first: {p for s in m.spans for p in range(s.start, s.start + s.words)} for m in marks if m.spans}
    assert got == covered([(i, t) for t, i in once.items()], 50)
    out = {r.doc_id: r for r in suffixes.dedup(clean).select("row.doc_id", "row.text", "clean_text", "n_removed").collect()}
    assert len(out) == len(rows) and sum(PASSAGE in (r.clean_text or "").replace("\n", " ") for r in out.values()) == 1
    for i, r in out.items():
        if not r.n_removed:
            assert r.clean_text == r.text
        else:
            assert len(r.clean_text.split()) == len(r.text.split()) - r.n_removed
    assert covered([(i, r.clean_text) for i, r in out.items()], 50) == {}
    assert suffixes.dedup(empty).count() == 0 and suffixes.dedup(docs).count() == docs.count()


def test_copies_of_a_long_text(spark):
    df = spark.createDataFrame([(3, words(1, 80)), (1, words(1, 80)), (2, words(2, 20)), (4, words(2, 20))], "doc_id long, text string")
    got = {r.doc_id: (r.clean_text, r.n_removed) for r in suffixes.dedup(df).select("row.doc_id", "clean_text", "n_removed").collect()}
    assert got == {1: (words(1, 80), 0), 3: ("", 80), 2: (words(2, 20), 0), 4: (words(2, 20), 0)}


def test_without():
    assert suffixes.without("a  b\nc d ", []) == "a  b\nc d "
    assert suffixes.without("a  b\nc d ", [(1, 2)]) == "a  d"
    assert suffixes.without("a b", [(0, 5)]) == ""


@pytest.mark.parametrize("shard_rows", [20, 1000])
def test_vectors(spark, shard_rows):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 12))
    x = [*base, *(base[0] + 0.02 * r.normal(size=(40, 12))), *(base[1:20] + 0.05 * r.normal(size=(19, 12))), base[3], base[3], 2 * base[3]]
    rows = [(i, [float(v) for v in b]) for i, b in enumerate(x)]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0] * 11 + [None], [float("inf")] + [1.0] * 11, [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(900 + n, v) for n, v in enumerate(odd)], "vec_id long, embedding array<double>")
    unit = vectors.unit_rows(np.array(x))
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {v.id: v for v in vectors.near_vectors(df, shard_rows=shard_rows).collect()}
    assert len(got) == len(rows) + len(odd)
    links = {(a, b) for a, b in zip(*np.nonzero(near))}
    found = sum(min(got[i].n_links, int(near[i].sum())) for i in range(len(x)))
    assert found >= 0.99 * len(links) and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    component = list(range(len(x)))
    for _ in range(len(x)):
        component = [min([component[i], *(component[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    assert [got[i].component_id for i in range(len(x))] == component
    assert all(got[900 + n].n_links == 0 and got[900 + n].component_id == 900 + n for n in range(len(odd)))
    if shard_rows == 1000:
        share, links = vectors.audit_recall(df.where("vec_id < 900"), queries=30)
        assert share >= 0.99 and links > 100
        assert vectors.near_vectors(df.limit(0)).count() == 0


def test_extreme_vectors(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [1e200, 1e200]), (5, [2e200, 2e200]), (6, [1e-300, 0.0]), (7, [5.0, 0.0]), (7, [0.0, -2.0]), (8, [5.0, 0.0])]
    df = spark.createDataFrame([(i, v, "clash", 9) for i, v in rows], "vec_id long, embedding array<double>, key string, copies int")
    got = Counter((r.id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == Counter([(1, 2, 1), (2, 3, 2), (3, 0, 3), (4, 2, 1), (5, 2, 1), (6, 3, 2), (7, 3, 2), (7, 0, 7), (8, 3, 2)])


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_vector_recall_over_many_shards(spark, kind):
    """Of 4000 vectors in some 20 shards, 600 pairs of them planted a little above the threshold, nearly all links are found."""
    r = np.random.default_rng(7)
    base = r.normal(size=(2800, 32))
    if kind == "clustered":
        base = r.normal(size=(25, 32))[r.integers(0, 25, 2800)] * 1.2 + base
    unit = vectors.unit_rows(base)
    twin = vectors.unit_rows(r.normal(size=(600, 32)))
    twin -= (twin * unit[:600]).sum(axis=1, keepdims=True) * unit[:600]
    angle = np.arccos(r.uniform(0.951, 0.97, (600, 1)))
    x = np.concatenate([unit, np.cos(angle) * unit[:600] + np.sin(angle) * vectors.unit_rows(twin)])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {v.id: v.n_links for v in vectors.near_vectors(df, shard_rows=300).collect()}
    assert all(got[i] <= true[i] for i in got)
    assert true.sum() >= 1200 and sum(got.values()) >= 0.98 * true.sum()


def test_block_max_index():
    r = random.Random(5)
    made = []
    for _ in range(300):
        ids = sorted(r.sample(range(30), r.randrange(1, 6)))
        made.append((np.array(ids), np.array([r.random() for _ in ids])))
    index = toxicity.BlockMaxIndex(made, 40, width=16)
    for _ in range(200):
        ids = np.array(sorted(r.sample(range(40), r.randrange(0, 6))), np.int64)
        w = np.array([r.random() for _ in ids])
        every = sorted((-sum(x * dict(zip(*v, strict=True)).get(t, 0.0) for t, x in zip(ids.tolist(), w.tolist())), i) for i, v in enumerate(made))
        want = [(i, -s) for s, i in every if s < 0][:7]
        got = index.nearest(ids, w, 7)
        assert [s for s, _ in got] == pytest.approx([s for _, s in want])
    tied = toxicity.BlockMaxIndex([(np.array([1]), np.ones(1))] * 40, 2, width=4)
    assert [i for _, i in tied.nearest(np.array([1]), np.ones(1), 5)] == [0, 1, 2, 3, 4]
    assert toxicity.BlockMaxIndex([], 3).nearest(np.array([1]), np.ones(1), 5) == []


def toxic_tables(spark, n=400):
    r, bad = random.Random(6), ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(n):
        w = words(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for b in r.sample(bad, 2):
                w.insert(r.randrange(60), b)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "vile nasty"), (n + 2, "vile " * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (n, 0, 0), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).select("row.doc_id", "score", "evidence").collect()}
    right = [(got[i].score >= 0.5) == (i % 5 == 0) for i in range(400)]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in got.values())
    assert got[402].score > 0.5 > got[401].score and got[401].score == got[400].score and got[0].evidence
    assert toxicity.score(docs.limit(0), model).count() == 0
    again = toxicity.score(docs.union(docs).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)), model).select("row.doc_id", "row.score", F.col("score").alias("s")).collect()
    assert len(again) == 2 * docs.count() and all(r.score == "clash" and r.s == pytest.approx(got[r.doc_id].score) for r in again)
    for kind in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, kind)).collect()} == {0.0}
    few = toxicity.fit(docs, labels, max_labelled=100)
    assert 0 < few.index.n <= 100


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    rows = [("a/LICENSE", f"{mit}\n{words(1, 40)}"), ("a/b/x.txt", words(2, 30)), ("a/b/y.txt", f"{words(3, 30)}\n{gpl}\n{words(4, 9)}"), ("a/b/c/z.txt", words(5, 9)), ("/q/r.txt", words(6, 9)), (None, words(7, 9)), ("a//b/n.txt", None), ("p/COPYING", gpl), ("p/s/t.txt", words(8, 9))]
    df = spark.createDataFrame([(p, t, "clash") for p, t in rows], "path string, text string, license string")
    got = {r.path: (r.license, r.origin, r.declared_in) for r in licenses.scan_licenses(df).select("row.path", "license", "origin", "declared_in").collect()}
    assert got == {
        "a/LICENSE": ("MIT", "header", None), "a/b/x.txt": ("MIT", "inherited", "/a"), "a/b/y.txt": ("GPL-3.0", "header", None), "a/b/c/z.txt": ("MIT", "inherited", "/a"),
        "/q/r.txt": (None, "none", None), None: (None, "none", None), "a//b/n.txt": ("MIT", "inherited", "/a"), "p/COPYING": ("GPL-3.0", "file", None), "p/s/t.txt": ("GPL-3.0", "inherited", "/p"),
    }
    down = {r.path: r.license for r in licenses.scan_licenses(df, headers_declare=True).select("row.path", "license").collect()}
    assert down["a/b/x.txt"] == "GPL-3.0" and licenses.scan_licenses(df.limit(0)).count() == 0


def test_wrapped_headers():
    m = licenses.Matcher({"the": 900, "license": 30, "under": 200}, 1000)
    for name, mark in (("MIT", "# "), ("GPL-3.0", " * "), ("BSD-3-Clause", "// "), ("MPL-2.0", "-- ")):
        header = "\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[name][1], 60))
        got = m.scan(f"{mark}Copyright someone\n{header}\n\n{words(1, 300)}")
        assert got and got[1:] == (name, False) and got[0] > 0.95
    assert m.scan("\n".join(textwrap.wrap(words(2, 300), 60))) is None


@pytest.mark.parametrize(("name", "license"), [("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3")])
def test_license_files(name, license):
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no such file here")
    got = licenses.Matcher({"the": 900, "license": 30, "under": 200, "of": 900, "and": 900, "to": 800}, 1000).scan(open(path, encoding="utf-8").read())
    assert got and got[1] == license


def test_full_texts():
    m = licenses.Matcher({"the": 900, "license": 30, "under": 200}, 1000)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            wrapped = "\n".join(textwrap.wrap(text, 72))
            assert m.scan(f"Copyright (c) someone\n\n{wrapped}\n")[1] == name
            assert m.scan(f"// {wrapped}\n".replace("\n", "\n// ") + words(2, 200))[1] == name


def test_license_ties(spark):
    mit, text = licenses.TEMPLATES["MIT"][0], f"{licenses.TEMPLATES['MIT'][0]}\n{licenses.TEMPLATES['Apache-2.0'][0]}\n{words(3, 60)}"
    rows = [("a/x", text), ("a/x", text), ("a/y", ""), ("a/z", f"{words(1, 60_000)}\n{mit}"), ("a/LICENSE", mit), ("a/COPYING", licenses.TEMPLATES["ISC"][0])]
    df = spark.createDataFrame([(p, t, 1, "x") for p, t in rows], "path string, text string, dir int, key string")
    got = Counter((r.path, r.license, r.origin) for r in licenses.scan_licenses(df).select("row.path", "license", "origin").collect())
    assert got == Counter([("a/x", "Apache-2.0", "header")] * 2 + [("a/y", "ISC", "inherited"), ("a/z", "MIT", "header"), ("a/LICENSE", "MIT", "file"), ("a/COPYING", "ISC", "file")])


def test_matcher_skips_nothing():
    m = licenses.Matcher({"the": 900, "license": 30, "under": 200}, 1000)
    every = licenses.Matcher({"the": 900, "license": 30, "under": 200}, 1000)
    every.telling = set(every.idf)
    r, known = random.Random(8), sorted(m.idf)
    lines = [[r.choice(known) for _ in range(r.randrange(1, 9))] for _ in range(300)] + [licenses.terms(t) for ts in licenses.TEMPLATES.values() for t in ts]
    assert all(m.best(x) == every.best(x) for x in lines)
    assert all(m.best(licenses.terms(t))[0] == pytest.approx(1) for ts in licenses.TEMPLATES.values() for t in ts)


def test_pipeline(spark, tmp_path):
    docs, labels = toxic_tables(spark, 200)
    rows = [(r.doc_id, r.text, "en", f"s{(r.doc_id or 0) % 3}", len(r.text or "")) for r in docs.collect()]
    rows += [(1000, rows[1][1] + " tail", "en", "s1", 9), (1001, f"{' '.join(f'own{i}' for i in range(30))} {PASSAGE}", "en", "s1", 9), (1002, f"{' '.join(f'other{i}' for i in range(40))} {PASSAGE}", "en", "s2", 9), rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        columns, kept = kept.columns, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in kept.collect()}
        if name != "bpe":
            assert kept.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tox, near, cut, mix, last = seen.values()
    assert 0 not in tox and 1 in tox and 1000 in tox
    assert 1 in near and 1000 not in near and 1001 in near and 1002 in near
    assert sum(PASSAGE in r.text for r in cut.values() if r.text) == 1 and {1001, 1002} <= set(cut) and cut[1].text == tox[1].text
    assert set(mix) < set(cut) and set(last) == set(mix) and all(r.n_tokens == len(r.ids) for r in last.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mix)


def test_pipeline_without_rows_or_labels(spark, tmp_path):
    docs, labels = toxic_tables(spark, 30)
    rows = [(r.doc_id, r.text, "en", "s", len(r.text or ""), "clash", 5) for r in docs.collect()]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row string, key int"
    for name, found, known in (("empty", [], labels), ("unlabelled", rows, labels.limit(0)), ("clean", rows, labels.where("toxic = 0"))):
        spark.createDataFrame(found, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        known.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.drop_toxic(spark, kept, f"{tmp_path}/{name}").count() == len(found)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/unlabelled")
    assert 0 < out.count() <= len(rows)
