"""BPE encoding and decoding: frequent words in a memory-mapped minimal transducer, unseen words merged exactly."""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, delete_at_exit, lean, packed, shared_dir, write_bytes

#: Words in the lexicon at most; its file is a few MB, whatever the corpus.
MAX_WORDS = 50_000

#: Code points of the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The one split pattern whose words the standard library finds as well, in texts of ASCII and Latin letters, three times
#: as fast: there \\w is exactly letters, the ten digits and the underscore.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\w{WHITE}]|_)+")
_OTHER = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


def byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Vocabulary:
    """A tokenizer file of the kind word_bpe: NFC, lower case, split by its pattern, byte-level BPE with word ends."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for table in (self.ids, self.special):
            for t, i in table.items():
                self.strings[i] = t
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words, self.known_pattern = regex.compile(pattern.replace("\\s", WHITE)), pattern == _PATTERN
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.bytes = byte_characters()

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # characters are lowered one by one: no final sigma
        return text.lower()

    def _plain(self, text: str) -> list[str]:
        if self.known_pattern and not _OTHER.search(text):
            return _PLAIN_WORDS.findall(text.lower())  # such text is in NFC, and each of its letters lowers to letters
        return self.words.findall(self.normalized(text))

    def split(self, text: str) -> list[str]:
        """Words of a text in order; a special token stands as itself behind a NUL, which no other word starts with."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for n, piece in enumerate(self.cut.split(text)):
            out += [f"\0{piece}"] if n % 2 else self._plain(piece)
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of one word by the merges in order of rank, leftmost first; n log n for any length."""
        if word[:1] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        symbols = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        if symbols:
            symbols[-1] += self.suffix
        ids = [self.ids[s] for s in symbols if s in self.ids]
        n = len(ids)
        after, before, ranks = [*range(1, n), -1], [*range(-1, n - 1)], self.ranks
        heap = [(ranks[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (p := (ids[i], ids[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in ranks:
                heapq.heappush(heap, (ranks[p][0], before[i], *p))
        return [x for x in ids if x >= 0]


# --- lexicon -------------------------------------------------------------------------------------------------------


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """A minimal acyclic transducer from the words' UTF-8 bytes to their ids, as one block of bytes.

    Words are added in byte order and finished states are merged with equal ones (the incremental construction of
    Daciuk and others), so common suffixes share states. Arcs carry the number of words before them; their sum along
    a path is the word's rank, which points into the table of ids.
    """
    coded = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in words.items())
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) whose arc's target may still grow

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte = path.pop()
            child = arcs[state][byte]
            arcs[state][byte] = register.setdefault((final[child], tuple(arcs[child].items())), child)

    last = b""
    for word, _ in coded:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        last = word
    settle(0)
    order: list[int] = []  # states below the root, children before parents
    seen: set[int] = set()
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            order.append(s)
        elif s not in seen:
            seen.add(s)
            stack.append((s, True))
            stack += [(c, False) for c in arcs[s].values() if c not in seen]
    count: dict[int, int] = {}
    for s in order:
        count[s] = final[s] + sum(count[c] for c in arcs[s].values())
    number = {s: i for i, s in enumerate([0, *(s for s in order if s)])}
    rows = []
    for s in number:
        n = int(final[s])
        for byte, c in sorted(arcs[s].items()):
            rows.append((number[s] << 8 | byte, number[c], n))
            n += count[c]
    rows.sort()
    ids = [ids for _, ids in coded]
    parts = [
        np.array([r[0] for r in rows], np.int64),
        np.array([r[1] for r in rows], np.int32),
        np.array([r[2] for r in rows], np.int32),
        np.array([final[s] for s in number], np.int8),
        np.cumsum([0, *map(len, ids)]).astype(np.int32),
        np.array([x for i in ids for x in i], np.int32),
    ]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """A compiled lexicon, read where it lies (a memory map, or any bytes)."""

    def __init__(self, data):
        sizes = np.frombuffer(data, np.int64, 6)
        parts, at = [], 48
        for n, kind in zip(sizes, (np.int64, np.int32, np.int32, np.int8, np.int32, np.int32), strict=True):
            parts.append(np.frombuffer(data, kind, int(n), at))
            at += parts[-1].nbytes + -parts[-1].nbytes % 8
        self.keys, self.next, self.out, self.final, self.start, self.ids = parts

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[str]) -> np.ndarray:
        """The rank of each word in the lexicon, or -1: all words take one step at a time, side by side."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(c) for c in coded], np.int64)
        if not len(self.keys) or not len(coded):
            return np.full(len(coded), -1)
        text = np.frombuffer(b"".join(coded), np.uint8)
        begin = np.cumsum(length) - length
        state, rank = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
        alive = np.flatnonzero(length > 0)
        rank[length == 0] = -1
        step = 0
        while len(alive):
            key = state[alive] << 8 | text[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = self.next[at]
            rank[alive] += self.out[at]
            step += 1
            ended = length[alive] == step
            done = alive[ended]
            rank[done[self.final[state[done]] == 0]] = -1
            alive = alive[~ended]
        return rank

    def lookup(self, rank: int) -> np.ndarray:
        return self.ids[self.start[rank] : self.start[rank + 1]]


# --- tables --------------------------------------------------------------------------------------------------------


class _Encoder:
    """What a worker keeps between batches and tasks: the words it met, as numbers of rows in a table of ids."""

    bound = 300_000

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lexicon = vocabulary, lexicon
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        ranks, flat, size = self.lexicon.ranks(words).tolist(), [], []
        for w, r in zip(words, ranks, strict=True):
            ids = self.lexicon.lookup(r).tolist() if r >= 0 else self.v.merge(w)
            flat += ids
            size.append(len(ids))
        at = len(self.start) - 1
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size, dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text in the ids, and the ids."""
        split = [self.v.split(t) if t else [] for t in texts]
        if len(self.known) > self.bound or len(self.flat) > 20 * self.bound:
            self.clear()
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        rows = np.fromiter((r for words in split for r in map(get, words)), np.int64, sum(map(len, split)))
        first, size = self.start[rows], self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        by_word = np.concatenate([np.zeros(1, np.int64), ends])
        return by_word[np.concatenate([np.zeros(1, np.int64), np.cumsum([len(w) for w in split])])], ids


def _vocabulary(content: str, held: dict = {}) -> Vocabulary:  # noqa: B006  one per worker
    if held.get("content") != content:
        held.update(content=content, vocabulary=Vocabulary(content))
    return held["vocabulary"]


def _encoder(content: str, name: str, held: dict = {}) -> _Encoder:  # noqa: B006  one per worker
    if held.get("name") != name:
        held.update(name=name, encoder=_Encoder(_vocabulary(content), Lexicon.mapped(SparkFiles.get(name))))
    return held["encoder"]


def _slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def frequent_words(df: DataFrame, content, text_col: str, most: int = MAX_WORDS) -> list[str]:
    """The most frequent words of the whole table: all that occur at least so often, and twice, that they are at most `most`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = _vocabulary(content.value), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    seen.update(v.split(text))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    stage = Staging(df.sparkSession)
    try:
        counted = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counted = stage.table(counted.where("n > 1"))
        # the frequencies that few words have come one by one, the others as powers of two, so the list is short
        level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(1024) * F.floor(F.pow(2.0, F.floor(F.log2(F.col("n") / 1024.0)))))
        least, words = None, 0
        for r in sorted(counted.groupBy(level.cast("long").alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
            words += r["words"]
            if words > most:
                break
            least = r["level"]
        return [] if least is None else [bytes(r["word"]).decode("utf-8", "surrogatepass") for r in counted.where(F.col("n") >= least).select("word").collect()]
    finally:
        stage.close()


def _placed(df: DataFrame, tokenizer: str, text_col: str, max_words: int):
    """What workers need to encode: the tokenizer's content as a broadcast, and the name of the lexicon's file.

    The file lies in the shared folder until the driver ends, as an executor that comes later fetches it from there.
    """
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    v = Vocabulary(content.value)
    words = {w: v.merge(w) for w in frequent_words(df, content, text_col, max_words)}
    name = f"orrery-lexicon-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    write_bytes(spark, path, compile_lexicon(words))
    delete_at_exit(spark, path)
    spark.sparkContext.addFile(path)
    return content, name


def _rows(df: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    rows = packed(df).select("row", F.col(f"row.`{text_col}`").alias("text"))
    return rows if keep is None else rows.select(F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row"), "text")


def encode(df: DataFrame, tokenizer: str, *, text_col: str = "text", keep: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """(row struct of the columns to keep, ids array<int>): each whole text as the tokenizer file encodes it.

    tokenizer: path, on the driver, of a file of the kind word_bpe. Word counts over the whole table choose the
    lexicon's words; its file lies in the shared folder, Spark fetches it for each executor, later ones too, and all
    workers there map it read-only. Words outside it are merged exactly. Null and empty texts have no ids.
    The strings of special tokens stand for themselves. No shuffle but the word counts'. Texts are taken a few MB at
    a time, so a very long one takes memory in proportion to its own length; repeated rows fare alike; columns of df
    stay inside row, so no name can clash.
    """
    content, name = _placed(df, tokenizer, text_col, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(content.value, name)
        for whole in batches:
            for batch in _slices(whole, "text"):
                offsets, ids = coder.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["row", "ids"])

    rows = _rows(df, text_col, keep)
    return rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def _joined(lists: pa.Array, table: pa.Array) -> pa.Array:
    """The tokens of each list of ids joined by one space; ids that the table does not have are left out."""
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ids = flat.to_numpy(zero_copy_only=False) if not flat.null_count else flat.fill_null(-1).to_numpy(zero_copy_only=False)
    good = (ids >= 0) & (ids < len(table))
    counts = np.bincount(row[good], minlength=len(sizes))
    tokens = table.take(pa.array(ids[good], pa.int32()))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")
    return pc.if_else(pc.is_valid(lists), joined, None)


def decode(df: DataFrame, tokenizer: str, *, ids_col: str = "ids") -> DataFrame:
    """df with a column decoded: the ids' tokens joined by one space, as these files have no decoder.

    Special tokens are not skipped; ids that the file does not have are; a null list has a null text.
    """
    with open(tokenizer, encoding="utf-8") as f:
        strings = Vocabulary(f.read()).strings
    shared = df.sparkSession.sparkContext.broadcast(strings)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _joined(batch.column(ids_col), table)], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lean(run), f"{fields}, decoded string")


def round_trip(df: DataFrame, tokenizer: str, *, text_col: str = "text", keep: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """(row, ids, decoded) as encode and then decode give them, in one pass: one Python worker per task, not two."""
    content, name = _placed(df, tokenizer, text_col, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(content.value, name)
        table = pa.array(coder.v.strings, pa.string())
        for whole in batches:
            for batch in _slices(whole, "text"):
                offsets, ids = coder.encode(batch.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), lists, _joined(lists, table)], ["row", "ids", "decoded"])

    rows = _rows(df, text_col, keep)
    return rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def op1_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
