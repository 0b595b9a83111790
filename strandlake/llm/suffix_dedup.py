"""Repeated passages by sparse suffix arrays.

1. Of each text, the suffixes are retained that start at minimiser positions: word positions whose
   KGRAM-word hash is the least of a window of WINDOW such hashes. They depend on content only, and
   any WINDOW + KGRAM - 1 words hold one, so a shared passage of MIN_WORDS words has them at the same
   places in all its copies.
2. Retained positions whose hash occurs once in the corpus can't match and go; this shuffles 64-bit
   hashes and positions, no text. Exact copies of a text go on as one text.
3. What is left is sorted as a suffix array: range partitions over the words that follow, sorted
   within; ties go on by text and position, so a passage that a third of all documents share spreads
   over many partitions.
4. Neighbours are compared: words in common to the right of the position, then to the left. Where
   they add up to MIN_WORDS, that span is repeated in both. A suffix is compared with up to NEIGHBOURS
   before it, fewer when a neighbour already matches as far as its window reaches. Neighbours across
   the border of two partitions are compared in a last step that sees NEIGHBOURS rows a partition side.
5. Suffixes that agree over KGRAM words are a run. In a run of more than NEIGHBOURS + 1, each window of
   MIN_WORDS words around the retained position gets its least (doc_id, text, place) by an aggregate:
   all others repeat it later. For the first and last run of a partition, which can go on in the
   next ones, each window's least place is also compared with those of other partitions, by its hash.

A window of MIN_WORDS to the right and MIN_WORDS - KGRAM to the left of a position is enough: the
positions within a passage lie closer than that, so their spans join to the whole passage.

`spans` are all repeated words; `drops` those that a document with a smaller doc_id, or an earlier
place of the same document, also has: without them one copy of each passage stays.

Exactness: any MIN_WORDS words hold a retained position, so `spans` and `drops` are all windows of
MIN_WORDS words that occur elsewhere, and earlier, in another document or place, whatever the number
of copies. Suffixes whose words begin with control characters below 9 can part a run and lose that.

Edge cases: null and empty texts, and texts under MIN_WORDS words, have no spans. Rows with the same
doc_id and text are one document; rows with the same doc_id and different texts are several. Rows
without a doc_id are documents of their own and sort before others: of copies, one of them stays.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

MIN_WORDS, KGRAM, WINDOW, NEIGHBOURS = 50, 24, 25, 8

#: Stands for a null doc_id where rows are put in order.
_FIRST = -(1 << 63)
_C = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * _C + b
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def retained(words: list[bytes], k: int = KGRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the retained suffixes and the hashes of their first k words."""
    if len(words) < k + window - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        h, done, size = None, 0, 1
        while done < k:
            if k & size:
                n = len(words) - k + 1
                part = power[done : done + n]
                h = part if h is None else _pair(h, part)
                done += size
            if done < k:
                power = _pair(power[:-size], power[size:])
                size *= 2
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at, h[at]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, positions, counts = [], [], []
        for text in batch.column("text").to_pylist():
            at, h = retained(text.encode("utf-8", "surrogatepass").split())
            keys.append(h)
            positions.append(at)
            counts.append(len(at))
        own = batch.column("text_id").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
        key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        pos = np.concatenate(positions).astype(np.int32) if positions else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(key), own, pa.array(pos)], ["key", "text_id", "pos"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["suffix", "before", "doc_id", "text_id", "pos"]
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, doc, own, positions in zip(*[batch.column(c).to_pylist() for c in ("text", "doc_id", "text_id", "positions")], strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            for p in sorted(positions):
                out[0].append(b" ".join(words[p : p + MIN_WORDS]).decode("utf-8", "replace"))
                out[1].append(b" ".join(words[max(0, p - MIN_WORDS + KGRAM) : p]).decode("utf-8", "replace"))
                out[2].append(doc)
                out[3].append(own)
                out[4].append(p)
            if len(out[0]) > 5000:
                yield _batch(out, names)
                out = [[], [], [], [], []]
        if out[0]:
            yield _batch(out, names)


def _batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Row:
    __slots__ = ("before", "doc", "pos", "raw_before", "raw_suffix", "suffix", "text")

    def __init__(self, suffix: str, before: str, doc: int | None, text: bytes, pos: int):
        self.raw_suffix, self.raw_before, self.doc, self.text, self.pos = suffix, before, doc, text, pos
        self.suffix, self.before = suffix.split(" "), before.split(" ")[::-1] if before else []

    def order(self) -> tuple:
        return (_FIRST if self.doc is None else self.doc, self.text, self.pos)


def _matches(row: _Row, earlier: deque[_Row], out: list[tuple]) -> None:
    """Compares row with those before it, nearest first."""
    for other in reversed(earlier):
        if other.text == row.text and other.pos == row.pos:
            continue
        right = len(row.suffix) if row.raw_suffix == other.raw_suffix else _common(row.suffix, other.suffix)
        if right < KGRAM:
            return
        left = _common(row.before, other.before)
        if left + right >= MIN_WORDS:
            late = row.order() > other.order()
            out.append((row.text, row.pos - left, row.pos + right, other.doc, late))
            out.append((other.text, other.pos - left, other.pos + right, row.doc, not late))
            if right == MIN_WORDS and left == MIN_WORDS - KGRAM and late:
                return


_FOUND = "text_id binary, start int, end int, other bigint, late boolean, edge int, side int, nth int, suffix string, before string, doc_id bigint, pos int, window bigint"


def _found(spans: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    rows = [(*s, *[None] * 8) for s in spans] + edges
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)


class _Run:
    """Sorted rows that agree over KGRAM words. Of rows with the same words on both sides only the least is held."""

    def __init__(self, key: list[str]):
        self.key, self.size = key, 0
        self.least: dict[tuple[str, str], _Row] = {}

    def add(self, row: _Row, out: list[tuple]) -> None:
        self.size += 1
        words = row.raw_suffix, row.raw_before
        held = self.least.setdefault(words, row)
        if held is row or (held.text == row.text and held.pos == row.pos):
            return
        if row.order() < held.order():
            self.least[words], row, held = row, held, row
        if len(row.before) + len(row.suffix) >= MIN_WORDS:
            for x, late in ((row, True), (held, False)):
                out.append((x.text, x.pos - len(x.before), x.pos + len(x.suffix), None, late))

    def close(self, out: list[tuple], border: bool) -> list[tuple]:
        """Spans go to out; at a border, the least place of each window is returned."""
        if self.size <= NEIGHBOURS + 1 and not border:
            return []
        least: dict[int, tuple[_Row, int]] = {}
        reach: dict[tuple[int, bool], tuple[_Row, int, int]] = {}

        def repeated(row: _Row, left: int, late: bool) -> None:
            # windows of a row all hold its position: together they are one span
            _, a, b = reach.get((id(row), late), (row, 0, 0))
            reach[id(row), late] = row, max(a, left), max(b, MIN_WORDS - left)

        for row in self.least.values():
            words, at = row.before[::-1] + row.suffix, len(row.before)
            for left in range(max(0, MIN_WORDS - len(row.suffix)), at + 1):
                h = xxhash.xxh3_64_intdigest(" ".join(words[at - left : at - left + MIN_WORDS]), left)
                held, _ = least.setdefault(h, (row, left))
                if held is not row:
                    first, last = (row, held) if row.order() < held.order() else (held, row)
                    least[h] = first, left
                    repeated(first, left, False)
                    repeated(last, left, True)
        out.extend((x.text, x.pos - left, x.pos + right, None, late) for (_, late), (x, left, right) in reach.items())
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return [(x.text, x.pos - left, x.pos - left + MIN_WORDS, *[None] * 7, x.doc, x.pos, signed(h)) for h, (x, left) in least.items()] if border else []


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: spans, the rows at its two ends, and the windows of its first and last run."""
    part, earlier, first = TaskContext.get().partitionId(), deque(maxlen=NEIGHBOURS), []
    edge = lambda side, n, r: (r.text, None, None, None, None, part, side, n, r.raw_suffix, r.raw_before, r.doc, r.pos, None)
    run, border, windows = None, True, []
    for batch in batches:
        spans: list[tuple] = []
        for values in zip(*[batch.column(c).to_pylist() for c in ("suffix", "before", "doc_id", "text_id", "pos")], strict=True):
            row = _Row(*values)
            if earlier and earlier[-1].text == row.text and earlier[-1].pos == row.pos:
                continue  # a row of the same doc_id and text
            if run is None or row.suffix[:KGRAM] != run.key:
                if run is not None:
                    windows += run.close(spans, border)
                    border = False
                run = _Run(row.suffix[:KGRAM])
            run.add(row, spans)
            _matches(row, earlier, spans)
            earlier.append(row)
            if len(first) < NEIGHBOURS:
                first.append(row)
        yield _found(spans, [])
    spans = []
    if run is not None:
        windows += run.close(spans, True)
    yield _found(spans, windows + [edge(0, n, r) for n, r in enumerate(first)] + [edge(1, n, r) for n, r in enumerate(earlier)])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the ends of all partitions, in order: spans of neighbours in different partitions."""
    earlier: deque[_Row] = deque(maxlen=NEIGHBOURS)
    ends: list[tuple[int, _Row]] = []
    now = None
    for batch in batches:
        spans: list[tuple] = []
        for part, side, values in zip(batch.column("edge").to_pylist(), batch.column("side").to_pylist(), zip(*[batch.column(c).to_pylist() for c in ("suffix", "before", "doc_id", "text_id", "pos")], strict=True), strict=True):
            if part != now:
                earlier.extend(r for _, r in ends)
                now, ends = part, []
            row = _Row(*values)
            if side == 0:
                _matches(row, earlier, spans)
            else:
                ends.append((part, row))
        yield _found(spans, [])


def _merged(pairs: Column) -> Column:
    """Sorted (start, end) structs, joined where they touch."""
    kind = "array<struct<start:int,end:int>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(pairs), F.array().cast(kind), add)


def _length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])


def _text_id() -> Column:
    """128 bits for a text: two texts of a corpus aren't taken for one."""
    return F.unhex(F.md5("text"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text) with a repeated passage: doc_id, n_words, repeated_words, dropped_words, spans, drops, partners (doc_ids of some neighbours in the array, at most NEIGHBOURS * 2, for a look at a case: spans and drops don't follow from them)."""
    return _repeats(docs).drop("text_id", "nth")


def _repeats(docs: DataFrame) -> DataFrame:
    """The same, with text_id, and nth: the number of a row without a doc_id among those of its text, else 1."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    own = own.withColumn("text_id", _text_id())
    n_words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    light = materialize(own.select("doc_id", "text_id", n_words.alias("n_words")).where(F.col("n_words") >= MIN_WORDS), "texts")
    # rows of one doc_id and text are one document; rows without a doc_id are documents of their own and come first
    nulls = F.count_if(F.col("doc_id").isNull())
    several = (nulls > 1) | ((nulls == 1) & (F.count("doc_id") > 0)) | (F.min("doc_id") < F.max("doc_id"))
    texts = light.groupBy("text_id").agg(F.min("doc_id").alias("least"), nulls.alias("nulls"), several.alias("copied"))
    texts = texts.select("text_id", F.when(F.col("nulls") == 0, F.col("least")).alias("rep"), "nulls", "copied")

    places = own.select("text_id", "text").mapInArrow(_positions, "key bigint, text_id binary, pos int")
    # one shuffle by key: its rows stay only where another text or place has the key
    places = materialize(places, "places")
    often = places.groupBy("key").agg(F.min(F.struct("text_id", "pos")).alias("a"), F.max(F.struct("text_id", "pos")).alias("b")).where("a <> b").select("key")
    shared = places.join(often, "key", "left_semi").groupBy("text_id").agg(F.collect_set("pos").alias("positions"))
    wanted = shared.join(texts.select("text_id", "rep"), "text_id").select(F.col("text_id").alias("want"), "positions", "rep")
    found = own.join(wanted, (F.col("doc_id").eqNullSafe(F.col("rep"))) & (F.col("text_id") == F.col("want"))).select("text", "doc_id", "text_id", "positions")
    suffixes = materialize(found.mapInArrow(_suffixes, "suffix string, before string, doc_id bigint, text_id binary, pos int"), "suffixes")
    discard(places)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    array = suffixes.repartitionByRange(tasks, "suffix", "text_id", "pos").sortWithinPartitions("suffix", "text_id", "pos")
    compared = materialize(array.mapInArrow(_neighbours, _FOUND), "neighbours")
    discard(suffixes)
    ends = compared.where("edge is not null").repartition(1).sortWithinPartitions("edge", "side", "nth")
    # the least place of a window in each partition, where runs can go on in others
    same, place = Window.partitionBy("window"), F.struct(F.coalesce("doc_id", F.lit(_FIRST).cast("bigint")).alias("doc"), "text_id", "pos")
    windows = compared.where("window is not null").withColumn("place", place).withColumn("least", F.min("place").over(same)).withColumn("most", F.max("place").over(same))
    beyond = windows.where("least <> most").select("text_id", "start", "end", F.lit(None).cast("bigint").alias("other"), (F.col("place") > F.col("least")).alias("late"))
    columns = ["text_id", "start", "end", "other", "late"]
    spans = compared.where("edge is null and window is null").select(columns).unionByName(ends.mapInArrow(_borders, _FOUND).select(columns)).unionByName(beyond)

    pair = F.struct("start", "end")
    by_text = spans.groupBy("text_id").agg(
        _merged(F.collect_set(pair)).alias("spans"),
        _merged(F.collect_set(F.when(F.col("late"), pair))).alias("drops"),
        F.array_sort(F.slice(F.array_sort(F.collect_set("other")), 1, 2 * NEIGHBOURS)).alias("partners"),
    )
    both = texts.join(by_text, "text_id", "left").where("copied or spans is not null")
    none = F.array().cast("array<struct<start:int,end:int>>")
    # a copy of a whole text: all of it is repeated, and dropped but for the copy with the least doc_id
    # rows without a doc_id are alike but for their number: the first of a text is 1
    named = light.where("doc_id is not null").join(both, "text_id").withColumn("nth", F.lit(1).cast("bigint"))
    counted = light.where("doc_id is null").select("text_id", "n_words").distinct()
    unnamed = counted.join(both, "text_id").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "nulls"))).withColumn("doc_id", F.lit(None).cast("bigint"))
    result = named.unionByName(unnamed)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    copy, first = F.col("copied"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("nth") == 1)
    partners = F.coalesce("partners", F.array().cast("array<bigint>"))
    result = result.select(
        "doc_id",
        "text_id",
        "nth",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy & ~first, whole).otherwise(F.coalesce("drops", none)).alias("drops"),
        F.when(copy & ~first & F.col("rep").isNotNull(), F.array_union(F.array("rep"), partners)).otherwise(partners).alias("partners"),
    )
    return result.select("doc_id", "text_id", "nth", "n_words", _length(F.col("spans")).alias("repeated_words"), _length(F.col("drops")).alias("dropped_words"), "spans", "drops", "partners")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, drops: list[tuple[int, int]]) -> str:
    """The text without the words of drops and the blanks that follow them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in drops:
        out.append(text[at : starts[a]])
        at = starts[min(b, len(starts) - 1)]
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, in its own columns, with dropped passages cut from text; rows left without a word go. n_chars, where it is a column, follows."""
    own = docs.columns
    drops = _repeats(docs).where("dropped_words > 0")
    # a row is known by doc_id and text; those without a doc_id go to their text's first row
    kept = drops.where("doc_id is not null or nth = 1").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text"), F.col("drops").alias("__drops")).distinct()
    n_words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    copies = F.coalesce(F.col("doc_id").isNull() & (n_words >= MIN_WORDS), F.lit(False))
    fresh = docs.where(~copies).unionByName(docs.where(copies).dropDuplicates(["text"]))
    joined = fresh.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_id() == F.col("__text")), "left")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    kinds = {f.name: f for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, chars = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__drops").to_pylist(), strict=True):
                new = cut(text, [(s["start"], s["end"]) for s in spans]) if spans else text
                keep.append(not spans or bool(new.strip()))
                texts.append(new)
                chars.append(None if new is None else len(new))
            columns = []
            for c in own:
                kind = batch.schema.field(c).type
                columns.append(pa.array(texts, kind) if c == "text" else batch.column(c))
            if "n_chars" in kinds:
                j = own.index("n_chars")
                changed = pa.array([bool(s) for s in batch.column("__drops").to_pylist()])
                columns[j] = pa.compute.if_else(changed, pa.array(chars, pa.int64()).cast(batch.schema.field("n_chars").type), batch.column("n_chars"))
            yield pa.RecordBatch.from_arrays(columns, own).filter(pa.array(keep, pa.bool_()))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    return joined.select(*own, "__drops").mapInArrow(run, schema)
