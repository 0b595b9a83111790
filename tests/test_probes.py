"""Joins in blocks of a broadcast index against plain joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.functions import kmers as A
from strandlake.operators import probes, sketches
from strandlake.plans.tables import materialize


def reads(spark, n=120):
    r = random.Random(5)
    base = ["".join(r.choice("ACGT") for _ in range(220)) for _ in range(8)]
    rows = [(i, "".join(c if r.random() > 0.02 else r.choice("ACGT") for c in r.choice(base)[r.randrange(60) :])) for i in range(n)]
    # a copy, a short one, an empty one, one without an id, one id of two reads
    rows += [(900, rows[0][1]), (901, "ACGTACG"), (902, ""), (None, rows[1][1]), (903, rows[2][1]), (903, rows[3][1])]
    return spark.createDataFrame(rows, "read_id bigint, seq string")


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_seeds_by_pair_over_several_blocks(spark, monkeypatch):
    own = materialize(sketches.minimizers(reads(spark), 11, 5), "minimizers")
    met = sketches.seed_join(own, own, 60)
    plain = met.groupBy("query_id", "read_id", "rev").agg(F.count("*"), F.min("query_pos"), F.max("ref_pos"))
    monkeypatch.setattr(probes, "BLOCK_ROWS", 700)
    found = sketches.seed_pairs(own, 60)
    assert tuples(found) == tuples(plain) and found.count() > 1000
    # anchors, which grow with the square of a minimizer's reads, are not shuffled
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_sketch_pairs_over_several_blocks(spark, monkeypatch):
    own = materialize(sketches.minhash(reads(spark), 15, 20), "sketches")
    l, r = (own.select(F.col("read_id").alias(c), "hash_idx", "min_hash") for c in "ab")
    met = l.join(r, ["hash_idx", "min_hash"])
    plain = met.groupBy("a", "b").agg(F.count("*").alias("matches")).where("matches >= 4")
    monkeypatch.setattr(probes, "BLOCK_ROWS", 500)
    rising = sketches.sketch_self_join(own, 4)
    assert tuples(rising) == tuples(plain.where("a < b")) and rising.count() > 100
    assert tuples(sketches.sketch_join(own, own, 4)) == tuples(plain.where("a is not null and b is not null"))
    assert "Exchange" not in rising._jdf.queryExecution().executedPlan().toString()


def test_aligned_pairs_equal_shuffled_kmers(spark, monkeypatch):
    some = reads(spark).where("read_id is not null and read_id < 903")
    own = materialize(sketches.minhash(some, 15, 20), "sketches")
    plain = sketches.sort_merge_align(sketches.sketch_self_join(own, 4), sketches.kmers(some, 6), 5)
    monkeypatch.setattr(probes, "BLOCK_ROWS", 500)
    found = sketches.sketch_align(some, own, 4, 6, 5)
    assert tuples(found) == tuples(plain) and found.count() > 100
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_pieces_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(probes, "MEETINGS", 10)
    owner, n = np.array([0, 0, 1, 3, 3, 3, 4]), np.array([4, 5, 30, 2, 2, 2, 9])
    cut = [owner[p].tolist() for p in probes._pieces(owner, n, 6)]
    assert sum(cut, []) == owner.tolist()
    assert all(not set(a) & set(b) for a, b in zip(cut, cut[1:], strict=False))


def test_kmers_of_a_batch_are_rolled_as_one():
    assert A.rolling(A.SKETCH_CODES[np.frombuffer(b"ATCG", np.uint8)], 2).tolist() == [1, 6, 11]


def test_replay_of_odd_pairs():
    from strandlake.plans.file_queries import replayed

    r = random.Random(8)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    pairs = [(word(40), word(50)), ("ACGT", "ACGT"), ("AAAA", "AA"), ("", "ACG"), ("ACG", ""), (w := word(60), w[:20] + "T" + w[25:])]
    for x, y in pairs:
        rows = [*range(len(y) + 1)]
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(rows[j] + 1, new[-1] + 1, rows[j - 1] + (c != d)))
            rows = new
        assert replayed(x, y) == (y, x, True, rows[-1])


def test_chains_are_looked_for_where_enough_anchors_meet(spark):
    from strandlake.operators import mapping
    from strandlake.plans.presets import Preset

    p = Preset(k=13, w=5, min_count=4, min_score=60, max_gap=200, band=100)
    assert mapping.fewest_anchors(13, p) == 5 and mapping.fewest_anchors(13, Preset(k=13, w=5, min_count=7, min_score=20)) == 7
    r = random.Random(3)
    rows = [(g, 1000 + g, g % 2, 20 * a + r.randrange(5), 20 * a + r.randrange(5)) for g in range(60) for a in range(g % 9)]
    found = mapping.chains(spark.createDataFrame(rows, "query_id bigint, read_id bigint, rev int, q int, r int"), 13, p)
    wanted = []
    for g in range(60):
        own = sorted((x[4], x[3]) for x in rows if x[0] == g)
        wanted += [(g, total, len(way)) for total, way in mapping.chain(np.array([q for _, q in own]), np.array([t for t, _ in own]), 13, p)] if own else []
    assert sorted((x.query_id, x.score, x.anchors) for x in found.collect()) == sorted(wanted) and wanted
    # pairs with too few anchors don't reach Python
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_anchors_are_scored_as_many_are():
    from strandlake.operators import mapping
    from strandlake.plans.presets import Preset

    p = Preset(k=13, w=5, min_count=2, min_score=20, max_gap=200, band=100)
    r = random.Random(6)
    for _ in range(200):
        n = r.randrange(1, 40)
        at = sorted((r.randrange(400), r.randrange(400)) for _ in range(n))
        t, q = np.array([x for x, _ in at]), np.array([y for _, y in at])
        for a, b in zip(mapping._scored(q, t, 13, p), mapping._scored_few(q.tolist(), t.tolist(), 13, p), strict=True):
            assert a.tolist() == b.tolist()


def documents(tmp_path, rows):
    """A folder with a documents table of (doc_id, text)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_replay_of_reads_of_any_length_equals_sql(spark, tmp_path, monkeypatch):
    import duckdb

    from strandlake.plans import catalog

    r = random.Random(12)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    changed = lambda w: "".join(c if r.random() > 0.01 else r.choice(["", c + "A", "G"]) for c in w)
    long, short = word(900), word(200)
    # long and short ones, copies, an id of two reads, an id of a read and of none
    rows = [(1, long), (2, changed(long)), (3, long), (4, changed(long) + word(300)), (5, short), (6, changed(short)), (6, changed(short)), (7, short), (7, None), (None, long), (8, None), (9, "")]
    sf = documents(tmp_path, rows)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    key = lambda t: tuple((v is None, v) for v in t)
    wanted = sorted(db.execute(catalog.ORACLE["align_replay"]).fetchall(), key=key)
    monkeypatch.setattr(probes, "TEXT_BYTES", 3_000)
    found = sorted(map(tuple, catalog.QUERIES["align_replay"](spark, sf).collect()), key=key)
    assert found == wanted and sum(len(t[3] or "") > 600 for t in found) >= 6 and any(t[5] is None for t in found)


def test_least_operations_of_letters_as_bits():
    from strandlake.functions import extension

    r = random.Random(4)
    for n, m in [(0, 0), (0, 5), (7, 0), (1, 1), (3, 70), (70, 3), (64, 64), (200, 150), (400, 400)]:
        for letters in ("AC", "ACGT", "ACGTé"):
            x, y = ("".join(r.choice(letters) for _ in range(k)) for k in (n, m))
            least = extension.edit_ops(*(np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (x, y)))
            for bits in (1, 3_000, 200_000_000):
                ops = extension.least_ops(x, y, bits)
                assert len(ops) - ops.count("=") == len(least) - least.count("u")
                i = j = 0
                for op in ops:
                    assert op in "ID" or (x[i] == y[j]) == (op == "=")
                    i, j = i + (op != "D"), j + (op != "I")
                assert (i, j) == (n, m)


def test_long_alike_reads_are_aligned_in_little_time():
    import time

    from strandlake.plans.file_queries import replayed

    r = random.Random(9)
    x = "".join(r.choice("ACGT") for _ in range(5_000))
    y = "".join(c if r.random() > 0.1 else r.choice(["", c + "A", "G"]) for c in x)
    began = time.process_time()
    assert replayed(x, y)[:3] == (y, x, True)
    # 0.06 s; 6.2 s with two tables, a vector of numbers a letter
    assert time.process_time() - began < 0.6


def test_chains_in_blocks_equal_chains_of_shuffled_anchors(spark, monkeypatch):
    from strandlake.operators import mapping
    from strandlake.plans.presets import Preset

    p = Preset(k=9, w=4, min_count=3, min_score=30, max_gap=60, band=40)
    r = random.Random(14)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    own = [(x.read_id, x.seq) for x in reads(spark, 60).collect()]
    repeat = "".join(r.choice("ACGT") for _ in range(30))
    own += [(1000, turn(own[4][1])), (1001, repeat * 6), (1002, turn(repeat * 4) + own[5][1]), (1003, own[6][1][:60] + "".join(r.choice("ACGT") for _ in range(150)) + own[6][1][60:])]
    every = spark.createDataFrame(own, "read_id bigint, seq string")
    asked = every.where("read_id % 3 = 1")
    index = materialize(sketches.minimizers(every, p.k, p.w), "index")
    seeds = sketches.minimizers(asked, p.k, p.w)
    wanted = mapping.chains(mapping.oriented(sketches.seed_join(seeds, index, 10_000), asked, p.k), p.k, p)
    sizes = asked.select("read_id", F.length("seq").alias("n"))
    places = seeds.join(sizes, "read_id").select("read_id", "minimizer", "pos", "strand", (F.col("n") - F.col("pos") - p.k).alias("turned"))
    monkeypatch.setattr(probes, "ANCHOR_ROWS", 300)
    monkeypatch.setattr(probes, "MEETINGS", 500)
    found = mapping.block_chains(probes.by_read(index, "targets"), probes.by_read(places, "queries"), p.k, p, True)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect())) and found.where("rev = 1").count() > 5 and found.count() > 100
    # before, each anchor was shuffled and each pair was a table of its own
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_anchors_of_few_places_are_chained_in_little_time():
    import time

    from strandlake.operators import mapping
    from strandlake.plans.presets import Preset

    p = Preset(k=13, w=5, min_count=4, min_score=60, max_gap=200, band=100)
    at = np.arange(0, 1_000, 10)
    r, q = np.repeat(at, len(at)), np.tile(at, len(at))
    began = time.process_time()
    score, parent = mapping._scored(q, r, 13, p)
    assert score.max() == 13 + 99 * 10 and parent[0] == -1
    # 0.16 s; with a vector an anchor 0.87 s
    assert time.process_time() - began < 0.5
