"""Token-id files: Parquet list columns that allow selective reads of tokens and metadata.

Layout: one row a document, in ascending doc_id order over the files: doc_id, n_tokens, crc (unsigned
crc32 of the ids as little-endian 32-bit integers), tokens (list of int). Version 2 pages hold the
integers in dictionary or, where a dictionary doesn't pay, delta encoding; row groups and pages have
a fixed size, and page indexes (written by default) let a reader that asks for some doc_ids skip
pages, and one that asks for metadata never touch the tokens.

Encoding: as the library encodes whole texts without adding special tokens; strings of special tokens
within a text become those tokens, as it does by default. The tokenizer drops white space and never merges over it, so each run of other characters
is encoded by the library once and remembered, in a store in each Python worker that holds at most
about REMEMBERED runs: those met since it was last half full, and those met in the half before. Plain new runs are cut where
the tokenizer cuts, and each part goes to the library's model alone: normalising and cutting it once more would cost more than its merges.
Python sees one Arrow batch at a time, of at most BATCH_ROWS documents.

Order: documents are dealt by ranges of doc_id and sorted within them, so hot values of other columns
don't matter. `start` (tokens before a document) is a running sum within a file plus the totals of the
files before it; only one total a file meets in one task.

Edge cases: a null text is an empty one and has only the end id. A null doc_id sorts first. Rows with
the same doc_id are ordered by length, then text. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

END_ID = 2
#: Runs remembered by a Python worker; documents in a batch; bytes of a row group and of a page.
REMEMBERED, BATCH_ROWS, ROW_GROUP, PAGE = 1_000_000, 1024, 32 << 20, 256 << 10

_SCHEMA = "doc_id bigint, n_tokens bigint, crc bigint, tokens array<int>"


class RunEncoder(dict):
    """Run of characters without white space -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # the half of the store before this one: what is met again moves on, the rest goes with it
        self.older: dict[str, bytes] = {}
        # strings that the library takes out of a text before it cuts it: texts that hold one go to it whole
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # the model sees bytes, each as a letter: letters of plain runs beyond ASCII are two of them
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelled(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.merged = self.tokenizer.model.tokenize
        probe = [*(c for c in map(chr, range(0x100)) if _PLAIN(c)), "wordword", "stra\u00dfe", "\u00e9t\u00e9", "!?", "..."]
        if self._parts(probe) != list(map(self._run, probe)):  # another kind of tokenizer
            self._parts = lambda parts: list(map(self._run, parts))

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of plain parts, each a word of the model."""
        ids, at = [], [0]
        for found in map(self.merged, " ".join(parts).translate(self.spelling).split(" ")):
            ids += [t.id for t in found]
            at.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _run(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, runs: list[str]) -> None:
        """Puts new runs, each named once, into the store."""
        whole, cut, parts, todo = [], {}, set(), []
        older = self.older.get
        for r in runs:
            if (known := older(r)) is not None:
                self[r] = known
            elif r.isalpha() and (r.isascii() or _PLAIN(r)):
                todo.append(r)
            elif r.isprintable() and _PLAIN(r):
                cut[r] = p = _PARTS(r)
                parts.update(p)
            elif r:
                whole.append(r)
        for p in parts.difference(todo):
            if (known := older(p)) is not None:
                self[p] = known
            elif p not in self:
                todo.append(p)
        if todo:
            self.update(zip(todo, self._parts(todo), strict=True))
        for r, p in cut.items():
            self[r] = b"".join(map(self.__getitem__, p))
        for r in whole:
            self[r] = self._run(r)
        self[""] = b""

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()
        plain = [self._plain(t or "") for t in texts]
        split = pa.compute.split_pattern(pa.array([p or "" for p in plain], pa.string()), " ")
        coded = split.values.dictionary_encode()
        runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.get, runs))
        if new := [i for i, x in enumerate(known) if x is None]:
            self.learn([runs[i] for i in new])
            for i in new:
                known[i] = self[runs[i]]
        taken = pa.array(known, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
        raw = memoryview(taken.buffers()[2]) if taken.buffers()[2] is not None else memoryview(b"")
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [self._run(t) if p is None else bytes(raw[a:b]) for t, p, a, b in zip(texts, plain, cuts, cuts[1:], strict=False)]

    def _plain(self, text: str) -> str | None:
        """The text with a blank between its runs; None if it must go to the library whole."""
        low = text.lower()
        if any(x in low for x in self.special):
            return None
        if "\u03a3" in text:
            # the library lower-cases each character alone; this letter's lower case depends on its place here
            return text.replace("\n", " ")
        low = low.replace("\n", " ")
        # the library cuts between a letter or digit and a mark: apart, most runs are words seen before
        return low if _AFTER_MARK(low) else low.replace(". ", " . ").replace(", ", " , ")


#: A full stop or comma after another mark, which the library would keep together.
_AFTER_MARK = re.compile(r"[.,](?<=(?:[^\w ]|_).)").search
#: Runs of letters that normal form C leaves alone and ASCII marks without quotes or angle brackets: the library cuts them between letters and marks.
_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff!-&(-/:;=?@\[-`{-~]+").fullmatch
_PARTS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[!-&(-/:;=?@\[-`{-~]+").findall

_encoders: dict[str, RunEncoder] = {}


def _encode(path: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = RunEncoder(path)
        encoder = _encoders[path]
        for batch in batches:
            parts, ends, crcs = [], [0], []
            for ids in encoder.texts(batch.column("text").to_pylist()):
                ids += end
                parts.append(ids)
                ends.append(ends[-1] + len(ids) // 4)
                crcs.append(zlib.crc32(ids))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            counts = pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(crcs, pa.int64()), tokens], ["doc_id", "n_tokens", "crc", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text) and writes the files of the format to path."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("text"), "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.enable.dictionary": "true"}
    ordered.mapInArrow(_encode(tokenizer, end_id), _SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "crc", "tokens")) -> DataFrame:
    """The named columns only: metadata reads skip the pages of tokens."""
    return spark.read.schema(_SCHEMA).parquet(path).select(*columns)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks of the ids as read back: count and crc32, from the lists themselves."""
    for batch in batches:
        tokens = batch.column("tokens")
        ends, values = tokens.offsets.to_numpy(), memoryview(tokens.values.cast(pa.int32()).to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        counts = [int(b - a) for a, b in zip(ends, ends[1:], strict=False)]
        crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends.tolist()[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "file", "n_tokens", "ids_crc32"])


def token_file(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes and reads back; one row for each row of docs: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    # the writer's tasks, and so the ranges, are numbered in the names of the files
    read = spark.read.schema(_SCHEMA).parquet(path).select("doc_id", "tokens", F.col("_metadata.file_name").alias("file"))
    back = read.mapInArrow(_sums, "doc_id bigint, file string, n_tokens bigint, ids_crc32 bigint")
    totals = spark.read.schema(_SCHEMA).parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = back.withColumn("at", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(totals, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
