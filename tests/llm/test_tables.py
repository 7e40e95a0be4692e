"""Sharding, mixing, fingerprints, tokens and archives."""

import base64
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import bpe, mixing, sharding, simhash, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def test_sharding(docs, empty):
    got = sharding.shard(docs, shards=4, parts=8, tolerance=0.01).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    assert len(got) == docs.count()
    shards = defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1
        shards[r.shard].append(r)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    total, most = sum(r.size for r in got), max(r.size for r in got)
    assert all(sum(r.size for r in rows) <= total / 4 + most for rows in shards.values())
    again = sharding.shard(docs.repartition(5), shards=4, parts=8, tolerance=0.01)
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in again.select("row.doc_id", "shard").collect())
    assert sharding.shard(empty).count() == 0


def test_splitters(spark):
    heavy = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit(77 << 24)).otherwise(F.xxhash64("id").bitwiseAND(F.lit((1 << 60) - 1))).alias("key"), (F.col("id") % 5 + 1).alias("size"))
    found = sharding.find_splitters(heavy, 8, 0.01)
    keys = [(r.key, r.size) for r in heavy.collect()]
    for key, rows, size in zip(found.keys, found.rows, found.size):
        assert rows == sum(k < key for k, _ in keys) and size == sum(s for k, s in keys if k < key)
    assert found.rounds > 2 and found.keys == sorted(found.keys)


def water(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= most * sizes[s]}
        if not full:
            return target | {s: weight[s] * unit for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(docs, empty):
    got = mixing.mix(docs).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "taken", "repeats").collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        assert r.size == len((r.text or "").split())
        sizes[r.source] += r.size
    want = water(sizes, (5, 2, 1), 1.5, 2.0)
    for s, total in sizes.items():
        rows = [r for r in got if r.source == s]
        assert {r.source_size for r in rows} == {total} and rows[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in rows) - want[s]) <= 1.5 * max(r.size for r in rows) + 1e-9
        assert all(r.taken == r.size * r.repeats and r.repeats <= 2 for r in rows)
    again = mixing.mix(docs.repartition(7))
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again.select("row.doc_id", "taken").collect())
    small = mixing.mix(docs, share=0.3, most_repeats=1.0)
    less = {r.doc_id for r in small.where("taken > 0").select("row.doc_id").collect()}
    assert less < {r.doc_id for r in got if r.taken} and mixing.mix(empty).count() == 0


def fingerprint(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    return {r.n: (r.fingerprint.high, r.fingerprint.low) for r in simhash.fingerprints(df, ["n"], "t").collect()}


def test_fingerprints(spark, docs, empty):
    got = simhash.fingerprint_edits(docs, parts=4).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    by = {r.id: r for r in got if r.id is not None}
    for i, t in rows:
        assert by[i].n_chars == len(t) and 0 <= by[i].near_next <= 1
    ordered = sorted(rows, reverse=True)
    for (i, t), (j, u) in zip(ordered, ordered[1:]):
        if i in (5, 6) or j == 5:  # id 5 repeats
            continue
        k = len(t) // 3
        assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
        bits = bin(int(by[i].fingerprint, 16) ^ int(by[j].fingerprint, 16)).count("1")
        assert by[i].near_next == pytest.approx(1 - bits / 128)
    same = {by[i].fingerprint for i, t in rows if t == rows[40][1]}
    assert len(same) == 1 and simhash.fingerprint_edits(empty).count() == 0


def test_near_fingerprints(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, (40, 2))
    points = [tuple(map(int, b)) for b in base]
    for b in points[:10]:
        for flips in (1, 3, 4):
            high = b[0]
            for f in range(flips):
                high ^= 1 << (13 * f + 2)
            points.append((high, b[1]))
    df = spark.createDataFrame([((p,),) for p in [*points, points[0]]], "fingerprint struct<f:struct<high:bigint,low:bigint>>").select(F.col("fingerprint.f").alias("fingerprint"))
    got = {tuple(sorted([(r.a.high, r.a.low), (r.b.high, r.b.low)])) for r in simhash.near_fingerprints(df, radius=3).collect()}
    ones = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y))
    want = {tuple(sorted([x, y])) for n, x in enumerate(points) for y in points[n + 1 :] if ones(x, y) <= 3}
    assert got == want
    assert simhash.near_fingerprints(df, radius=3).count() == len(want)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcDE'stSσΣςİıßé́中²½٣_!. \t\n\x1c\x85 😀")), max_size=40), st.booleans())
def test_words_like_the_library(text, special):
    text = f"{text}<|endoftext|>{text}" if special else text
    assert [i for w in VOCABULARY.split(text) for i in VOCABULARY.merge(w)] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_lexicon():
    words = {w: VOCABULARY.merge(w) for w in ["a", "able", "table", "tables", "stable", "é", "日本", "ables"]}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    ranks = lexicon.ranks([*words, "tab", "", "tablesx", "zz"])
    assert sorted(ranks[: len(words)].tolist()) == list(range(len(words))) and (ranks[len(words) :] == -1).all()
    assert all(lexicon.lookup(r).tolist() == ids for r, ids in zip(ranks, words.values()))
    assert len(lexicon.final) < len({w[:n] for w in map(str.encode, words) for n in range(len(w) + 1)})  # shared suffixes
    assert (bpe.Lexicon(bpe.compile_lexicon({})).ranks(["a", ""]) == -1).all()


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_tokens(docs, empty, most):
    got = bpe.decode(bpe.encode(docs, PATH, max_words=most), PATH).select("row.text", "ids", "decoded").collect()
    assert len(got) == docs.count()
    for r in got:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    if not most:
        assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_decode_odd(spark):
    df = spark.createDataFrame([([1, -5, 10**6, 49407],), ([],), (None,)], "ids array<int>")
    assert {r.decoded for r in bpe.decode(df, PATH).collect()} == {f"{LIBRARY.id_to_token(1)} <|endoftext|>", "", None}


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "u\r\n1", "<p>x</p>"), (9, None, "<p>x</p>"), (4, "u", ""), (5, "u", None), (6, "u", "é" * 30_000), (7, "u", "only"), (None, "u", "only"), (8, "u", "z"), (8, "v", "z")]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df.repartition(2), f"{tmp_path}/w", records=3)
    got = {(r.record_id, r.target_uri): r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert len(got) == len(PAGES)
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, u, h in PAGES:
        r = got[f"urn:page:{'null' if i is None else i}", u and u.replace("\r", "%0D").replace("\n", "%0A")]
        data = (h or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        kept = i == best[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if kept else ("revisit", f"urn:page:{best[h or '']}"))
        assert bytes(r.payload) == (data if kept else b"")
    warc.write_archives(df, f"{tmp_path}/all", revisit_bytes=10**6)
    assert {r.record_type for r in warc.read_archives(spark, f"{tmp_path}/all", payloads=False).collect()} == {"response"}
    warc.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_broken_archives():
    dictionary = warc.train_dictionary([b"abc"], 1024)
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    record = warc.record_bytes("urn:page:1", "u", b"hello", warc.base32_sha1(b"hello"), None)
    lead = warc.skippable(warc.DICTIONARY_MAGIC, dictionary)
    good = lead + coder.compress(record) + warc.SEPARATOR.encode()
    assert [r["payload"] for r in warc.read_archive(good)] == [b"hello"]
    packed = warc.skippable(warc.DICTIONARY_MAGIC, zstandard.ZstdCompressor().compress(dictionary)) + coder.compress(record)
    assert len(list(warc.read_archive(packed))) == 1
    assert struct.unpack("<I", warc.SEPARATOR.encode()[:4])[0] == warc.SKIPPABLE_FIRST
    for bad in (good[:-3], good[: len(lead) + 9], b"junk" + good, lead + coder.compress(record[:-2]), lead + coder.compress(record.replace(b"hello", b"hullo")), lead + coder.compress(record.replace(b"WARC/1.1", b"WORC/1.1")), lead + coder.compress(record.replace(b"WARC-Date", b"WARC-Dote")), coder.compress(record)):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(bad))


def test_crc(spark):
    assert spark.range(1).select(F.crc32(F.lit("12").cast("binary"))).first()[0] == zlib.crc32(b"12")
