"""Byte-level BPE: which words the higher-order functions fold."""

import hashlib

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from strandlake.llm import byte_bpe

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SPLIT = regex.compile(public_tokenizers.PATTERN).findall


def text_ids(text):
    return " ".join(str(i) for w in SPLIT(text) for i in byte_bpe.fold(w.encode(), RANKS))


def test_rare_words_are_folded_by_higher_order_functions(spark, monkeypatch):
    # no word comes twice, so none is common; a fold that gives 7 for every word must show in all of them
    docs = spark.createDataFrame([(1, "qwxzv brumpf ilkott"), (2, "Zaunkönig-gnilf")], "doc_id bigint, text string")
    monkeypatch.setattr(byte_bpe.Encoder, "fold", lambda self, *_: F.array(F.lit(7).cast("bigint")))
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {1: "7 7 7", 2: "7 7 7"}


def test_words_of_a_task_are_handed_on_once_and_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(byte_bpe, "fold", lambda *_: [1, 2])  # for long words only
    long = "x" * (byte_bpe.LONG + 1)
    texts = ["the cat", "the cat sat", None, "the", long + " cat", "sat mat rat"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "text": texts})
    numbers = byte_bpe.Numbers(["the"])
    (out,) = byte_bpe.number_words(iter([batch]), numbers, SPLIT, {}, most=3)
    fresh = [[bytes(w).decode() for w in row] for row in out.column("fresh").to_pylist()]
    assert fresh == [[" cat"], [" sat"], [], [], [""], ["sat", " mat", " rat"]]
    assert out.column("words").to_pylist() == [[0, 1], [0, 1, 2], [], [0], [3, 1], [4, 5, 6]]
    assert out.column("long").to_pylist() == [[], [], [], [], ["1 2"], []]
    assert out.column("anew").to_pylist() == [True, False, False, False, False, False]
    (out,) = byte_bpe.number_words(iter([batch]), numbers, SPLIT, {}, most=2)
    assert out.column("anew").to_pylist() == [True, False, False, False, False, True]
    assert out.column("words").to_pylist()[-1] == [1, 2, 3]


def test_words_forgotten_and_long_ones_keep_results(spark, monkeypatch):
    texts = [f"{'ab' * (k % 5 * 60 + 1)} w{k} é漢字{k % 3} the the  {' ' * k}x \U0001f600{k % 2}" for k in range(400)] + ["", None, "z" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    whole = byte_bpe.number_words
    few = lambda *a: whole(*a, most=5)
    monkeypatch.setattr(byte_bpe, "number_words", few)
    rows = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, most=3).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == text_ids(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_fold_takes_the_first_of_equal_pairs(spark):
    # "aa" three times over five letters: pairs overlap, and abc is made as ab + c and as a + bc
    ranks = {bytes([x]): x for x in range(256)} | {b"aa": 256, b"bc": 257, b"ab": 259, b"abc": 258, b"abca": 260, b"aaab": 261}
    words = ["a" * n for n in range(1, 8)] + ["abcabc", "aabcab", "abcaabc", "caaabbc", "b"]
    encoder = byte_bpe.Encoder(ranks, r"\S+")
    out = spark.createDataFrame([(w,) for w in words], "w string").select("w", encoder.ids_texts(F.array(encoder.bytes_of(F.col("w"))))[0].alias("ids")).collect()
    for r in out:
        parts = [bytes([x]) for x in r.w.encode()]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert r.ids == " ".join(str(ranks[p]) for p in parts), r.w


def test_digests_of_rare_words(spark):
    texts = [f"glorf{k}mip Ünterk{k}öl" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        assert r.ids_sha256 == hashlib.sha256(text_ids(texts[r.doc_id]).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_plans_dont_hold_the_rank_map(spark):
    # some 250,000 numbers: as literals their text stays in the driver and the event log with each plan
    docs = spark.createDataFrame([(1, "glorf brumpf")], "doc_id bigint, text string")
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    plan = encoded._jdf.queryExecution()
    assert len(plan.toString()) < 100_000
    # and no row carries it: the projection with the fold stands on the split itself
    assert plan.executedPlan().toString().count("Project [") == 1
    assert encoded.first().ids == text_ids("glorf brumpf")
