"""Byte-level BPE in Spark's higher-order functions: ranked merges folded over the bytes of words.

A rank file maps byte strings to ranks, which are the ids. From it comes, on the driver, the map that
the fold needs: for each pair of ids whose joined bytes have a rank, that rank. It goes into the plan
as literals (a hash table whose buckets are each moved to free places), so a lookup costs the same
whatever its size.

The fold over one word keeps an array with an element for each id: the rank of the pair that begins
there, the place of its first byte, the id. Its least element is the pair of least rank, the first of
several; each step merges it and looks up the two pairs that are new. It ends when no pair has a rank.
Words come from the tokenizer's split pattern.

Distinct words are folded, not each word of each text. The commonest words of a sample, a bounded number,
are folded once and broadcast. A task's other words are folded once a task: Arrow batches split the texts
into numbered words and hand on those not met before, the higher-order functions fold them, and further
batches of the same task put texts together from the numbers. No row is shuffled, no text is split twice,
and no dictionary grows with the corpus: a task that has met too many words begins anew. Which words are
common changes no result. `encode_native` is the form without Python.

Decoding joins the binary pieces of the ids and knows nothing of the words.

Edge cases: a null text is an empty one, with no ids. A word of more than LONG bytes, for which an array
made anew at each step costs too much, is folded with a heap in Python. Empty tables give empty results;
repeated rows are encoded each on its own.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: Distinct words folded once, from a sample of so many documents; words a task remembers; bytes of a word folded by a heap.
COMMON_WORDS, SAMPLE_DOCS, REMEMBERED, LONG = 1 << 18, 16_000, 500_000, 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ints(values, kind: str = "int") -> Column:
    """A literal array: the optimizer folds the split once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a fold over nothing. Taking an element of an array would work out its type at each call."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


#: Arrays of the rank map, see Encoder.
_TABLES = ("shifts", "entries", "first")


class Encoder:
    """Expressions for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # Java's classes for white space and letters are those of ASCII unless told otherwise
        self.pattern = F.lit("(?U)" + pattern)
        top = max(ranks.values())
        #: An element of the fold: rank (`none`: the pair has none), place in `room` bits, id in `bits` bits.
        self.bits = (top + 1).bit_length()
        self.room, self.none = 62 - 2 * self.bits, 1 << self.bits
        found = ((a, b, rank) for token, rank in ranks.items() for cut in range(1, len(token)) if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None)
        self._place(np.fromiter((x for p in found for x in p), np.int64).reshape(-1, 3))
        #: Of each byte, before each byte or the end of the word (256): the element with place 0.
        first = [[ranks.get(bytes([x, y]), self.none) if y < 256 else self.none for y in range(257)] for x in range(256)]
        self.first = ((np.array(first, np.int64) << (self.bits + self.room)) | np.array([[ranks[bytes([x])]] for x in range(256)])).ravel()
        pieces = [b""] * (top + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.pieces = F.split(F.lit(",".join(p.hex() for p in pieces)), ",")

    def _place(self, pairs: np.ndarray) -> None:
        """A pair is at its key modulo `places`, moved by its bucket's shift; entries hold key and rank. Large buckets choose first."""
        n = len(pairs)
        keys = (pairs[:, 0] << self.bits) + pairs[:, 1]
        self.buckets, self.places = n // 3 + 1, n * 5 // 4 | 1
        bucket = keys % self.buckets
        while len(np.unique(bucket * (4 * n + 4) + keys % self.places)) < n:  # two of a bucket at one place can't be moved apart
            self.places += 2
        places, reach, rng = keys % self.places, self.places // 8 + 1, np.random.default_rng(0)
        order, counts = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        empty = ((1 << self.bits) - 1) << (2 * self.bits)  # no id is as large
        self.shifts, self.entries = np.zeros(self.buckets, np.int64), np.full(self.places + reach, empty, np.int64)
        for k in np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]:
            own = order[ends[k] - counts[k] : ends[k]]
            while not len(free := np.flatnonzero((self.entries[(tried := rng.integers(0, reach, 32))[:, None] + places[own]] == empty).all(axis=1))):
                pass
            self.shifts[k] = tried[free[0]]
            self.entries[self.shifts[k] + places[own]] = keys[own] << self.bits | pairs[own, 2]

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, self.pattern, F.lit(0))

    def tables(self) -> Column:
        """The rank map as one literal struct: a plan names it once, and lambdas refer to it."""
        return F.struct(*(_ints(getattr(self, x), "bigint").alias(x) for x in _TABLES))

    def with_tables(self, df: DataFrame) -> DataFrame:
        """df and the rank map as its column `tables`, a scalar subquery: a projection on top takes it in, so no row carries it."""
        row = pa.table({x: pa.array([getattr(self, x)], pa.list_(pa.int64())) for x in _TABLES})
        return df.withColumn("tables", df.sparkSession.createDataFrame(row).select(F.struct(*_TABLES)).scalar())

    def rank(self, m: Column, key: Column) -> Column:
        """Rank of the pair with this key by the tables m, or `none`; also for a null key."""
        entry = F.get(m["entries"], key % self.places + F.get(m["shifts"], key % self.buckets))
        return F.least(entry.bitwiseXOR(key * self.none), _long(self.none))

    def fold(self, m: Column, word: Column) -> Column:
        """Ids of a word, an array of bytes from 0 to 255, by the tables m."""
        above = self.bits + self.room
        places = _long(((1 << self.room) - 1) << self.bits)

        def token(x: Column) -> Column:
            return x.bitwiseAND(_long(self.none - 1))

        def step(s: Column, _: Column) -> Column:
            def merge(least: Column, place: Column, i: Column) -> Column:
                """The pair at i, from 1, becomes one element; the one before gets a new rank."""
                left, new = F.get(s, i - 2), F.shiftright(least, above)
                keys = F.array(token(left) * self.none + new, new * self.none + token(F.get(s, i + 1)))

                def renewed(r: Column) -> Column:
                    around = F.array(F.get(r, F.lit(0)) * (1 << above) + left.bitwiseAND(_long((1 << above) - 1)), F.get(r, F.lit(1)) * (1 << above) + place + new, _long(-1))
                    return _given(around, lambda e: F.array_remove(F.transform(s, lambda x, j: F.coalesce(F.get(e, j - i + 2), x)), _long(-1)))

                return _given(F.transform(keys, lambda k: self.rank(m, k)), renewed)

            def at(least: Column) -> Column:
                found = _given(least.bitwiseAND(places), lambda place: _given(F.size(F.filter(s, lambda x: x.bitwiseAND(places) < place)) + 1, lambda i: merge(least, place, i)))
                return F.when(least < _long(self.none << above), found).otherwise(s)

            return _given(F.array_min(s), at)

        start = F.transform(word, lambda x, j: F.get(m["first"], x * 257 + F.coalesce(F.get(word, j + 1), F.lit(256))) + j * self.none)
        return F.aggregate(word, start, step, lambda s: F.transform(s, token))

    def ids_texts(self, words: Column, tables: Column | None = None) -> Column:
        """Ids, in decimal and joined by blanks, of each of an array of words that are arrays of bytes. tables: the column of with_tables(), else literals."""
        own = self.tables() if tables is None else tables

        def texts(m: Column) -> Column:
            return F.transform(words, lambda w: F.array_join(self.fold(m, w).cast("array<string>"), " "))

        # taken apart once: the row that a subquery gives would make an array anew at each lookup
        return _given(own, lambda t: _given(F.struct(*(t[x].alias(x) for x in _TABLES)), texts))

    @staticmethod
    def bytes_of(word: Column) -> Column:
        return _given(F.hex(F.encode(word, "utf-8")), lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))

    def decode(self, ids: Column) -> Column:
        """Bytes of ids in decimal, joined by blanks."""
        joined = F.array_join(F.transform(F.split(ids, " "), lambda x: F.get(self.pieces, x.cast("int"))), "")
        return F.when(ids == "", F.lit(b"")).otherwise(F.unhex(joined))


def common_words(docs: DataFrame, encoder: Encoder, most: int = COMMON_WORDS, sample: int = SAMPLE_DOCS) -> pa.Table:
    """w, ids (in decimal) of the commonest words in about `sample` documents, at most `most` words: each is folded once."""
    share = min(1.0, sample / max(docs.count(), 1))
    picked = docs.where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30))
    words = picked.select(F.explode(encoder.words(F.col("text"))).alias("w")).where(F.length("w") <= 32)
    top = words.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(most).select("w")
    # from a table of their own: the one plan that reads the rank map then is a scan, a projection and no more
    tasks = max(1, min(64, docs.sparkSession.sparkContext.defaultParallelism * 2))
    found = encoder.with_tables(materialize(top.repartition(tasks), "common-words"))
    return found.select("w", encoder.ids_texts(F.array(encoder.bytes_of(F.col("w"))), F.col("tables"))[0].alias("ids")).toArrow()


class Numbers(dict):
    """Word -> its number: the common words first, then those that a task meets, in their order. `fresh`: those met since it was last emptied."""

    def __init__(self, common: list[str]):
        super().__init__(zip(common, range(len(common)), strict=True))
        self.common, self.fresh = len(common), []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        out = self[word] = len(self)
        return out

    def restart(self) -> None:
        self.fresh.clear()
        for _ in range(len(self) - self.common):
            self.popitem()


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the pair of least rank, the first of several, is merged until no pair has a rank. A heap of pairs keeps long words cheap."""
    return [whole] if (whole := ranks.get(word)) is not None else _fold_long(word, ranks)


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p : end[i]])) is not None:
            heapq.heappush(heap, (r, p, end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


_stores: dict[tuple, tuple] = {}


_NUMBERED = "doc_id bigint, anew boolean, words array<int>, fresh array<array<int>>, long array<string>"
_ENCODED = "doc_id bigint, ids string, n_tokens bigint, decoded binary"


def _lists(values: pa.Array, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), pa.int32()), values)


def number_words(batches: Iterator[pa.RecordBatch], numbers: Numbers, split: Callable[[str], list[str]], ranks: dict[bytes, int], most: int = REMEMBERED) -> Iterator[pa.RecordBatch]:
    """The words of each text by number, the bytes of words not met before (none for a long one), and the ids of long ones. anew: the task's own words are forgotten."""
    anew = True
    for batch in batches:
        starts, words, fresh, long = [], [], [], []
        for t in batch.column("text").to_pylist():
            if anew := anew or len(numbers) - numbers.common > most:
                numbers.restart()
            starts.append(anew)
            anew = False
            found = split(t or "")
            words.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            fresh.append([w.encode("utf-8") for w in numbers.fresh])
            numbers.fresh.clear()
            long.append([" ".join(map(str, fold(w, ranks))) for w in fresh[-1] if len(w) > LONG])
        short = [w if len(w) <= LONG else b"" for row in fresh for w in row]
        values = pa.array(np.frombuffer(b"".join(short), np.uint8).astype(np.int32))
        columns = [
            batch.column("doc_id"),
            pa.array(starts, pa.bool_()),
            _lists(pa.array(np.concatenate([np.zeros(0, np.int32), *words])), list(map(len, words))),
            _lists(_lists(values, list(map(len, short))), list(map(len, fresh))),
            pa.array(long, pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "anew", "words", "fresh", "long"])


def put_together(batches: Iterator[pa.RecordBatch], ids_of: list[str], common: int, pieces: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    """Ids of texts from the numbers of their words; ids_of: each number's ids, in decimal, each followed by a blank."""
    for batch in batches:
        lists = batch.column("words")
        words, ends = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum().tolist()
        ids, begin = [], 0
        for end, anew, fresh, long in zip(ends, *(batch.column(c).to_pylist() for c in ("anew", "fresh", "long")), strict=True):
            if anew:
                del ids_of[common:]
            rest = iter(long)
            ids_of.extend(f"{x or next(rest)} " for x in fresh)
            ids.append("".join(map(ids_of.__getitem__, words[begin:end].tolist())))
            begin = end
        decoded = [b"".join(map(pieces.__getitem__, x.split())) for x in ids]
        counts = pa.array([x.count(" ") for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[:-1] for x in ids], pa.string()), counts, pa.array(decoded, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = COMMON_WORDS) -> DataFrame:
    """doc_id, ids (in decimal, joined by blanks), n_tokens, decoded (bytes, from the ids alone) of each row of docs (doc_id, text)."""
    spark, encoder = docs.sparkSession, Encoder(ranks, pattern)
    # as Arrow columns: no object a word on the driver, and workers make only those they need
    sent = spark.sparkContext.broadcast((common_words(docs, encoder, most), ranks))
    forget(spark)
    number = sent._jbroadcast.id()

    def kept(role: str, make: Callable[..., tuple]) -> tuple:
        if (number, role) not in _stores:
            for old in [x for x in _stores if x[0] != number]:
                del _stores[old]
            _stores[number, role] = make(*sent.value)
        return _stores[number, role]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return number_words(batches, *kept("first", lambda common, own: (Numbers(common["w"].to_pylist()), regex.compile(pattern).findall, own)))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return put_together(batches, *kept("last", lambda common, own: ([f"{x} " for x in common["ids"].to_pylist()], common.num_rows, {str(r): t for t, r in own.items()})))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 256)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = encoder.with_tables(texts.mapInArrow(first, _NUMBERED))
    folded = numbered.select("doc_id", "anew", "words", encoder.ids_texts(F.col("fresh"), F.col("tables")).alias("fresh"), "long")
    return folded.mapInArrow(last, _ENCODED)


def encode_native(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The same by higher-order functions alone: every word of a text is folded in its row."""
    encoder = Encoder(ranks, pattern)
    ids = F.array_join(encoder.ids_texts(F.transform(encoder.words(F.coalesce("text", F.lit(""))), encoder.bytes_of)), " ")
    return docs.select("doc_id", _given(ids, lambda x: F.struct(x.alias("ids"), encoder.decode(x).alias("decoded"))).alias("e")).select("doc_id", "e.ids", "e.decoded")


def byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encoded = encode(docs, read_ranks(path), pattern)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
