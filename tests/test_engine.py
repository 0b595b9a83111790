"""Queries against DuckDB, and properties of the sequence and interval operators."""

import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strandlake.functions import sequences as S
from strandlake.operators import alignments, edits, intervals, sketches
from strandlake.operators.components import connected_components
from strandlake.plans import catalog
from strandlake.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(df):
    def cell(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_reverse_complement_is_an_involution(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(10_000))
    df = spark.createDataFrame([(seq,), ("",), ("N",)], "seq string")
    for row in df.select("seq", S.reverse_complement(S.reverse_complement(df.seq)).alias("twice")).collect():
        assert row.seq == row.twice


def test_script_makes_the_read(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        a = "".join(r.choice("ACGT") for _ in range(r.randrange(0, 80)))
        b = "".join(c for c in a if r.random() > 0.1) if i % 2 else "".join(r.choice("ACGT") for _ in range(r.randrange(0, 40)))
        rows.append((a, b, [{"op": o, "len": n, "base": x} for o, n, x in edits.script(b, a)]))
    df = spark.createDataFrame(rows, f"a string, b string, edits {edits.SCRIPT}")
    out = df.select("b", edits.apply_script(df.a, df.edits).alias("made"), edits.edit_distance(df.edits).alias("d"), edits.edit_text(df.edits).alias("t")).collect()
    assert all(x.b == x.made for x in out)


def test_archive_round_trip(spark):
    r = random.Random(8)
    genome = "".join(r.choice("ACGT") for _ in range(3000))
    rows = [(i, "".join(c if r.random() > 0.02 else r.choice("ACGT") for c in genome[:600])) for i in range(8)] + [(100 + i, "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 90)))) for i in range(6)]
    reads = spark.createDataFrame(rows, "read_id bigint, seq string")
    pairs = sketches.sketch_self_join(sketches.minhash(reads, 11, 20), 3)
    contigs, placements, lone = edits.encode(reads, connected_components(pairs, "a", "b"))
    assert contigs.count() + placements.count() + lone.count() == len(rows) and placements.count() >= 5
    assert sorted(map(tuple, edits.decode(contigs, placements, lone).collect())) == sorted(rows)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)], "src bigint, dst bigint")
    got = {x.node: x.component for x in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_islands_touching_or_not(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 20, 30), ("c", 22, 25)], "ctg string, st int, en int")
    assert sorted((x.st, x.en) for x in intervals.merged(df, ["ctg"]).collect()) == [(0, 9), (20, 30)]
    assert sorted((x.st, x.en) for x in intervals.merged(df, ["ctg"], touching=False).collect()) == [(0, 5), (5, 9), (20, 30)]


def test_overlap_join_bins(spark):
    r = random.Random(2)
    a = [(i, "c", s, s + r.randrange(1, 300)) for i in range(60) for s in [r.randrange(1000)]]
    df = spark.createDataFrame(a, "id int, ctg string, st int, en int")
    got = {(x.id, x.b_id) for x in intervals.overlap_join(df, df, ["ctg"], 64).collect()}
    assert got == {(x[0], y[0]) for x in a for y in a if x[2] < y[3] and y[2] < x[3]}


def test_call_and_liftover(spark):
    cs = spark.createDataFrame([("t", 10, "q", 60, ":5*ag:3+cc:2-tt:4")], "tname string, tstart int, qname string, mapq int, cs string")
    got = sorted((x.st, x.ref, x.alt) for x in alignments.call_variants(cs).collect())
    assert got == [(15, "a", "g"), (19, "-", "cc"), (21, "tt", "-")]
    paf = spark.createDataFrame([(1, "q", 0, 10, "+", 10, "t", 100, "4M2I4M")], "aln int, qname string, qstart int, qend int, strand string, qlen int, tname string, tstart int, cigar string")
    points = spark.createDataFrame([("q", 3), ("q", 5), ("q", 8)], "qname string, pos int")
    assert sorted((x.pos, x.tpos) for x in alignments.liftover(paf, points).collect()) == [(3, 103), (5, 104), (8, 106)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGU\n+\nIIII\n@r2\nGG\n+\nII\n")
    (tmp_path / "b.fa").write_text(">s1 about\nACG\nTTT\n>s2\nGG\n")
    (tmp_path / "c.paf").write_text("q\t10\t0\t10\t+\tt\t50\t5\t15\t9\t10\t60\ttp:A:P\tcg:Z:10M\n")
    (tmp_path / "d.bed").write_text("c\t0\t100\tg\t5\t+\t0\t0\t0\t2\t10,20,\t0,50,\n")
    (tmp_path / "e.vcf").write_text("##x\n#CHROM\nc\t5\t.\tA\tG,T\t50\tPASS\t.\n")
    (tmp_path / "f.reads").write_text("c:5:u3\nACG\nn:9:u2\nTT\n")
    assert [(x.read_id, x.name, x.seq) for x in files.sequences(spark, str(tmp_path / "a.fastq")).orderBy("read_id").collect()] == [(0, "r1", "ACGT"), (1, "r2", "GG")]
    assert [(x.name, x.comment, x.seq) for x in files.fasta(spark, str(tmp_path / "b.fa")).orderBy("record").collect()] == [("s1", "about", "ACGTTT"), ("s2", "", "GG")]
    row = files.paf(spark, str(tmp_path / "c.paf")).first()
    assert (row.qname, row.tstart, row.tags["cg"], row.tags["tp"]) == ("q", 5, "10M", "P")
    assert [(x.st, x.en) for x in files.bed12_introns(spark, str(tmp_path / "d.bed")).collect()] == [(10, 50)]
    assert files.vcf(spark, str(tmp_path / "e.vcf")).first().alt == ["G", "T"]
    assert [(x.is_rc, x.pos, x.seq) for x in files.sequences(spark, str(tmp_path / "f.reads")).orderBy("read_id").collect()] == [(True, 5, "ACG"), (False, 9, "TT")]
    files.write_paf(files.paf(spark, str(tmp_path / "c.paf")), str(tmp_path / "out"))
    assert files.paf(spark, str(tmp_path / "out")).first() == row
