"""Chains, alignments, masks, conversions and streams against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import pairwise as P
from strandlake.operators import mapping, sketches
from strandlake.plans.presets import PRESETS, Preset
from strandlake.sources import converters, files
from strandlake.streaming import reads as streams


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def brute_score(x, y, s):
    gap = lambda k: min(s["q"] + s["e"] * k, s["q2"] + s["e2"] * k)
    best = {}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            ways = [0] if i == j == 0 else []
            if i and j:
                ways.append(best[i - 1, j - 1] + (s["a"] if x[i - 1] == y[j - 1] else -s["b"]))
            ways += [best[k, j] - gap(i - k) for k in range(i)] + [best[i, k] - gap(j - k) for k in range(j)]
            best[i, j] = max(ways)
    return best[len(x), len(y)]


def test_align_is_optimal_and_spells_both():
    r = random.Random(4)
    for _ in range(40):
        x = dna(r, r.randrange(0, 30))
        y = "".join(c for c in x if r.random() > 0.2) + dna(r, r.randrange(0, 8))
        score, cigar = P.align(x, y)
        if x and y:
            assert score == brute_score(x, y, P.SCORES)
        parts = list(P.walk(cigar, x, y))
        assert "".join(a for _, a, _ in parts) == x and "".join(b for _, _, b in parts) == y
        assert all((a == b) == (op == "=") for op, a, b in parts if op in "=X")
        assert P.target_of_md(cigar, P.md_tag(cigar, x, y), x) == y
        assert P.eqx(P.merged(cigar), x, y) == cigar
    assert P.cs_tag("4M1D3M", "ACGTACG", "ACGTTACC") == ":4-t:2*cg"
    assert P.align("A" * 3000, "C" * 3000)[1] == "3000D3000I"


def brute_dust(seq, window, threshold):
    def ratio(i, j):
        t = [seq[a : a + 3] for a in range(i, j - 2)]
        return sum(t.count(x) * (t.count(x) - 1) // 2 for x in set(t)) / (len(t) - 1) if len(t) > 1 else 0

    n, on = len(seq), set()
    for i in range(n):
        for j in range(i + 4, min(n, i + window) + 1):
            own = ratio(i, j)
            if own * 10 > threshold and all(ratio(a, b) <= own for a in range(i, j) for b in range(a + 4, j + 1)):
                on |= set(range(i, j))
    return on


def test_dust():
    r = random.Random(5)
    for seq in (dna(r, 15) + "A" * 12 + dna(r, 12), dna(r, 10) + "ACACACACACACAC" + dna(r, 6), dna(r, 40)):
        for threshold in (10, 20):
            assert {p for a, b in P.dust(seq, 20, threshold) for p in range(a, b)} == brute_dust(seq, 20, threshold)
    assert P.dust("A" * 20 + "NNN" + "C" * 20) == [(0, 20), (23, 43)]
    assert P.dust("") == P.dust("ACG") == P.dust("NNNNNN") == []


def test_chain_takes_the_collinear_anchors():
    q = np.array([10, 30, 50, 70, 40])
    r = np.array([110, 130, 150, 170, 400])
    found = mapping.chain(q, r, 15, Preset(min_score=10, max_gap=100, band=50))
    assert found == [(60, [0, 1, 2, 3])]
    assert mapping.chain(q[:0], r[:0], 15, Preset()) == []


def test_map_reads_finds_places_on_both_strands(spark):
    r = random.Random(6)
    genome = dna(r, 4000)
    back = str.maketrans("ACGT", "TGCA")
    noisy = lambda s: "".join(r.choice(("", "A", c + c, c)) if r.random() < 0.03 else c for c in s)
    reads = [(k, noisy(genome[k * 300 : k * 300 + 800])[:: 1 if k % 2 else -1].translate(str.maketrans("", "") if k % 2 else back)) for k in range(1, 9)]
    queries = spark.createDataFrame([*reads, (50, dna(r, 300)), (51, "")], "read_id bigint, seq string")
    targets = spark.createDataFrame([(100, genome), (101, dna(r, 1000))], "read_id bigint, seq string")
    hits = mapping.map_reads(queries, targets, Preset(k=13, w=5))
    rows = hits.collect()
    tops = {x.query_id: x for x in rows if x["rank"] == 0}
    assert set(tops) == set(range(1, 9))
    seqs = dict(reads)
    for k, x in tops.items():
        assert x.read_id == 100 and x.strand == ("+" if k % 2 else "-")
        assert abs(x.tstart - k * 300) < 40 and abs(x.tend - k * 300 - 800) < 40 and x.mapq > 30 and x.nmatch > 0.85 * x.blen
        own = seqs[k][x.qstart : x.qend]
        own = own if x.strand == "+" else own[::-1].translate(back)
        assert P.target_of_md(x.cigar, x.md, own) == genome[x.tstart : x.tend]
    lines = [x.value.split("\t") for x in converters.sam_lines(hits, queries).collect()]
    assert {f[0] for f in lines if f[1] == "4"} >= {"50", "51"}
    for f in lines:
        if f[1] in ("0", "16"):
            assert sum(n for n, op in P.parse(f[5]) if op in "MIS") == len(f[9])


def test_query_maps_reads_of_large_copy_groups(spark):
    from strandlake.plans.mapping_queries import MAPPING

    r = random.Random(12)
    own = dna(r, 300)
    rows = spark.createDataFrame([(i, own) for i in range(60)], "read_id bigint, seq string")
    hits = mapping.map_reads(rows.where("read_id = 0"), rows, MAPPING, same_ids=True)
    assert hits.count() > 0


def test_parents(spark):
    found = spark.createDataFrame([(1, 10, 0, 100, 20, 0, 90, 0, 90), (1, 11, 0, 60, 9, 5, 80, 0, 75), (1, 12, 1, 50, 9, 0, 100, 0, 100)], "query_id bigint, read_id bigint, rev int, score int, anchors int, q_st int, q_en int, r_st int, r_en int")
    sizes = spark.createDataFrame([(1, "A" * 200)], "read_id bigint, seq string")
    got = {x.read_id: (x["rank"], x.parent, x.sub_score) for x in mapping.with_parents(found, sizes, Preset()).collect()}
    assert got == {10: (0, 0, 60), 11: (1, 0, 0), 12: (2, 2, 0)}
    assert {x.read_id for x in mapping.selected(mapping.with_parents(found, sizes, Preset()), Preset()).collect()} == {10, 12}


def test_presets():
    assert PRESETS["asm5"].scores["b"] == 19 and PRESETS["sr"].k == 21
    for wrong in ({"k": 29}, {"w": 0}, {"best_n": -1}, {"primary_ratio": 1.5}):
        with pytest.raises(ValueError):
            Preset(**wrong)


def test_delta_and_sam_and_annotations(spark, tmp_path):
    (tmp_path / "x.delta").write_text("a b\nNUCMER\n>t q 1000 900\n11 30 1 20 2 2 0\n5\n-3\n0\n50 60 40 30 0 0 0\n0\n")
    a, b = sorted(converters.delta_to_paf(spark, str(tmp_path / "x.delta")).collect(), key=lambda x: x.tstart)
    assert (a.cigar, a.tstart, a.tend, a.qstart, a.qend, a.strand, a.blen, a.nmatch) == ("4M1D2M1I13M", 10, 30, 0, 20, "+", 21, 19)
    assert (b.cigar, b.strand, b.qstart, b.qend) == ("11M", "-", 29, 40)
    (tmp_path / "x.sam").write_text("@SQ\tSN:t\tLN:500\nr1\t16\tt\t11\t60\t3S5M1I4M2D1M\t*\t0\t0\tACGTACGTACGTAC\t*\tNM:i:4\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    (p,) = converters.sam_to_paf(*files.sam(spark, str(tmp_path / "x.sam"))).collect()
    assert (p.qlen, p.qstart, p.qend, p.tstart, p.tend, p.nmatch, p.blen, p.strand, p.tlen, p.cigar) == (14, 0, 11, 10, 22, 9, 13, "-", 500, "5M1I4M2D1M")
    (tmp_path / "x.gtf").write_text('c\ts\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t1";\nc\ts\texon\t31\t45\t.\t+\t.\tgene_id "g"; transcript_id "t1";\n')
    (bed,) = converters.annotations_to_bed(converters.annotations(spark, str(tmp_path / "x.gtf"))).collect()
    assert (bed.st, bed.en, bed.name, bed.sizes, bed.starts) == (10, 45, "t1", "10,15,", "0,20,")
    spliced = spark.createDataFrame([("q", "+", "t", 100, 140, 60, "5M10N3M2I4D18M")], "qname string, strand string, tname string, tstart int, tend int, mapq int, cigar string")
    s = converters.splice_to_bed(spliced).first()
    assert (s.sizes, s.starts, s.n_blocks) == ("5,25,", "0,15,", 2)


def test_stream_of_reads_joins_the_index(spark, tmp_path):
    r = random.Random(9)
    genome = dna(r, 400)
    reads = spark.createDataFrame([(k, genome[k * 10 : k * 10 + 200]) for k in range(6)] + [(9, "ACG")], "read_id bigint, seq string")
    index = sketches.minhash(reads, 11, 12)
    grouped = {(x.read_id, x.hash_idx): x.min_hash for x in index.collect()}
    own = {(x.read_id, j): h for x in streams.row_sketches(reads, 11, 12).collect() for j, h in enumerate(x.sketch)}
    assert own == grouped
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    running = streams.overlaps(stream, index, 11, 12, 3).writeStream.format("memory").queryName("met").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    want = {(x.a, x.b): x.matches for x in sketches.sketch_join(index, index, 3).where("a <> b").collect()}
    assert {(x.a, x.b): x.matches for x in spark.table("met").collect()} == want and len(want) > 4


def test_cigar_text(spark):
    got = spark.sql("select array(named_struct('len', 3, 'op', 'M'), named_struct('len', 2, 'op', 'M'), named_struct('len', 1, 'op', 'D')) as o").select(converters.cigar_text(F.col("o")).alias("c")).first().c
    assert got == "5M1D"
