"""Each registered query over whole tables, against SQL, the public library or brute force."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from orrery.llm import licenses, queries, toxicity
from tests.llm.test_copies import classes, covered

SF = "/root/testdata/sf0.001"


def plain(rows):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("select doc_id, text from documents").fetchall())


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    found = tables.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(found.fetchall())


def test_tokens_like_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert plain(run(spark, "op1_bpe")) == want


def test_licenses_by_every_run_of_lines(spark, tables, texts):
    words = {w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.terms(t)}
    n = Counter(w for t in texts.values() for w in words.intersection(licenses.terms(t or "")))
    m = licenses.Matcher(n, len(texts))
    want = {}
    for i, t in texts.items():
        lines = [x for x in map(licenses.terms, (t or "").split("\n")) if x]
        every = [sum(lines[a:b], []) for a in range(len(lines)) for b in range(a + 1, min(len(lines), a + 12) + 1)]
        found = [f for f in map(m.best, [x for x in every if len(x) <= m.longest or len(x) == len(sum(lines, []))]) if f]
        want[i] = min(found, key=lambda f: (-f[0], f[1]))[1] if found else None
    got = run(spark, "op4_license_scan")
    assert {r.doc_id: r.license for r in got if r.origin in ("file", "header")} == {i: x for i, x in want.items() if x}
    assert len(got) == len(texts) and any(want.values())


def test_near_copies_by_all_pairs(spark, texts):
    rows = sorted(texts.items())
    want = classes(rows)
    got = {r.doc_id: (r.class_id, r.kept) for r in run(spark, "op5_order_minhash")}
    assert got == {rows[i][0]: (c, c == rows[i][0]) for i, c in want.items()}


def fingerprint(text):
    words = re.split("[ \t\n\x0b\f\r]+", text)
    votes, n = np.zeros(128, np.int64), len(words)
    for a, b in zip(words, [*words[1:], None]):
        for half, seed in enumerate((42, xxhash.xxh64_intdigest(struct.pack("<i", 1), 42))):
            h = xxhash.xxh64_intdigest(a.encode(), seed)
            h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
            votes[64 * half : 64 * half + 64] += (np.uint64(h) >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int64)
    return [sum(1 << j for j in range(64) if votes[64 * half + j] * 2 > n) for half in (0, 1)]


def test_fingerprints_by_votes(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op6_simhash")}
    ordered = sorted(texts, reverse=True)
    ones = lambda x, y: 1 - sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) / 128
    shown = lambda x: f"{x[0]:016x}{x[1]:016x}"
    own = {i: fingerprint(t or "") for i, t in texts.items()}
    for i, j in list(zip(ordered, [*ordered[1:], ordered[0]]))[::5]:
        t, u = texts[i] or "", texts[j] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        r, e = got[i], fingerprint(edited)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own[i]), shown(e))
        assert (r.near_edited, r.near_next) == (pytest.approx(ones(own[i], e)), pytest.approx(ones(own[i], own[j])))


def test_toxicity_by_every_example(spark, texts):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in run(spark, "op7_toxicity")}
    assert set(rows) == set(texts)
    label = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    frequency = Counter(w for t in texts.values() for w in set(toxicity.tokens(t)))
    examples = {i: y for i, y in label.items() if zlib.crc32(str(i).encode()) % 5 and i in texts}
    assert set(m.terms) == {w for i in examples for w in toxicity.tokens(texts[i])}
    by = defaultdict(lambda: [0, 0, None])
    for i, y in examples.items():
        counts = Counter(toxicity.tokens(texts[i]))
        key = tuple(sorted((m.terms[w], c) for w, c in counts.items()))
        by[key] = [by[key][0] + y, by[key][1] + 1, counts]
    weight = lambda w, c: (1 + np.log(c)) * (m.idf[m.terms[w]] if w in m.terms else m.unseen)

    def unit(counts):
        v = {w: weight(w, c) for w, c in counts.items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    held = [(a / np.sqrt(n), np.sqrt(n), unit(c)) for key, (a, n, c) in by.items() if key]
    share = (np.log((len(texts) + 1) / (np.array([frequency[w] for w in m.terms]) + 1)) + 1)
    assert (m.idf <= share + 1e-9).all() and (m.idf >= toxicity.FLOOR * share - 1e-9).all()
    for i, t in list(texts.items())[::3]:
        q = unit(Counter(toxicity.tokens(t)))
        near = sorted((-sum(x * v.get(w, 0.0) for w, x in q.items()), n) for n, (_, _, v) in enumerate(held))[: m.k]
        near = [(-c, n) for c, n in near if c < 0]
        if not near:
            assert rows[i].score == pytest.approx(m.bare)
            continue
        w = [(c / near[0][0]) ** 4 for c, _ in near]
        vote = (sum(x * held[n][0] for x, (_, n) in zip(w, near)) + m.prior / 2) / (sum(x * held[n][1] for x, (_, n) in zip(w, near)) + 0.5)
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(-(m.slope * np.log(vote / (1 - vote)) + m.offset))), abs=1e-6)
        assert [e.cosine for e in rows[i].evidence] == pytest.approx([c for c, _ in near[:3]])


def test_repeats_by_all_windows(spark, texts):
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t or "", i)
    want = covered([(i, t) for t, i in first.items()], 50)
    got, keepers = defaultdict(set), defaultdict(set)
    twice = Counter(t or "" for t in texts.values())
    for r in run(spark, "op9_suffix_dedup"):
        t = texts[r.doc_id] or ""
        whole = twice[t] > 1 and r.keeper_doc_id == first[t] and (r.start_word, r.n_words) == (0, len(t.split()))
        if first[t] == r.doc_id and not whole:
            got[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
        keepers[r.doc_id].add(r.removed)
    assert got == want
    copies = {i for i, t in texts.items() if len((t or "").split()) >= 50 and first[t] != i}
    assert all(True in keepers[i] for i in copies)
