"""Alignment kernels against brute force, contig graphs, archives, simulated reads and readers of files."""

import random

import numpy as np
import pytest

from strandlake.functions import extension as X
from strandlake.functions import kmers as A
from strandlake.functions import pairwise as P
from strandlake.functions import views
from strandlake.operators import archive, consensus, edits, mapping, sketches
from strandlake.plans import diagnostics
from strandlake.plans.presets import Preset
from strandlake.sources import files, simulation


def bases(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def noisy(r, s, p):
    return "".join("" if (u := r.random()) < p / 3 else c + r.choice("ACGT") if u < 2 * p / 3 else r.choice("ACGT") if u < p else c for c in s)


def cost(cigar, q, t):
    i = j = total = 0
    for n, op in P.parse(cigar):
        if op == "M":
            total += sum(P.SCORES["a"] if a == b else -P.SCORES["b"] for a, b in zip(q[i : i + n], t[j : j + n], strict=True))
        else:
            total -= int(P.gap_cost(np.int64(n), P.SCORES))
        i, j = i + n * (op in "MI"), j + n * (op in "MD")
    assert (i, j) == (len(q), len(t))
    return total


def pairs(n, seed):
    r = random.Random(seed)
    for k in range(n):
        a = bases(r, r.randrange(0, 60))
        b = noisy(r, a, 0.3) if k % 2 else bases(r, r.randrange(0, 60))
        yield a, b[:10] + bases(r, 40) + b[10:] if k % 5 == 0 else b


def test_banded_equals_the_whole_matrix():
    for k, (a, b) in enumerate(pairs(120, 1)):
        score, cigar = X.banded(a, b, (1, 3, 10, 40)[k % 4])
        assert score == P.align(a, b)[0] == cost(cigar, a, b)


def test_long_pairs_are_aligned_in_a_band():
    r = random.Random(2)
    a = bases(r, 900)
    b = noisy(r, a, 0.05)
    assert P.align(a, b, most_cells=1000)[0] == P.align(a, b)[0]


def test_edit_ops_are_least_however_the_pair_is_cut():
    for a, b in pairs(80, 3):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        for cells in (50, 4_000_000):
            ops = X.edit_ops(X._codes(a), X._codes(b), cells)
            assert sum(o != "u" for o in ops) == row[-1]


def test_extension_stops_where_the_score_drops():
    r = random.Random(4)
    s = bases(r, 300)
    other = s[:100] + bases(r, 200)
    score, q, t, cigar, dropped = X.extend(other, s, 50, 60)
    assert dropped and 95 <= q <= 110 and cost(cigar, other[:q], s[:t]) == score
    assert X.extend(s, s, 50, 60) == (600, 300, 300, "300M", False)


def test_spliced_finds_the_intron():
    r = random.Random(5)
    t = bases(r, 60) + "GT" + bases(r, 200) + "AG" + bases(r, 60)
    assert X.spliced(t[:60] + t[264:], t, {"a": 1, "b": 2, "q": 2, "e": 1, "q2": 32, "e2": 0})[1] == "60M204N60M"


def test_local_score_against_all_pieces():
    for a, b in pairs(12, 6):
        a, b = a[:14], b[:14]
        short = P.SCORES | {"q2": P.SCORES["q"], "e2": P.SCORES["e"]}
        best = max((P.align(a[i:j], b[k:m], short)[0] for i in range(len(a)) for j in range(i + 1, len(a) + 1) for k in range(len(b)) for m in range(k + 1, len(b) + 1)), default=0)
        assert X.local_score(a, b)[0] == max(best, 0)


def test_gaps_move_left():
    assert X.left_aligned("4M1D4M", "ACAATTTT", "ACAAATTTT") == ("2M1D6M", 0, 0)
    assert X.left_aligned("2I4M", "GGACGT", "ACGT") == ("4M", 2, 0)


def test_an_inversion_is_a_part_of_its_own():
    r = random.Random(7)
    t = bases(r, 3000)
    q = t[:1000] + t[1000:1600][::-1].translate(str.maketrans("ACGT", "TGCA")) + t[1600:]
    parts = mapping.align_chain(q, t, [100, 2500], [100, 2500], 15, Preset(drop=200, drop_inversion=100))
    assert [p["inv"] for p in parts] == [False, False, True]
    assert parts[0]["q_en"] <= 1030 and parts[1]["q_st"] >= 1570 and 550 <= parts[2]["matches"] <= 600
    whole = mapping.align_chain(t[50:], t, [100], [150], 15, Preset())
    assert (whole[0]["q_st"], whole[0]["q_en"], whole[0]["matches"]) == (0, 2950, 2950)


def test_compressed_minimizers_ignore_run_lengths():
    r = random.Random(8)
    s = bases(r, 400)
    longer = "".join(c * r.choice([1, 1, 3]) for c in s)
    assert set(A.minimizers(s, 13, 5, True)[3].tolist()) == set(A.minimizers(longer, 13, 5, True)[3].tolist())


def test_compressed_reads_are_mapped(spark):
    r = random.Random(9)
    t = bases(r, 3000)
    q = "".join(c * (2 if r.random() < 0.05 else 1) for c in t[500:2500])
    targets, queries = (spark.createDataFrame([(i, s)], "read_id bigint, seq string") for i, s in ((1, t), (2, consensus.turned(q))))
    hit = mapping.map_reads(queries, targets, Preset(k=15, w=5, homopolymers=True)).first()
    assert hit.strand == "-" and hit.nmatch > 1950 and abs(hit.tstart - 500) < 20 and abs(hit.tend - 2500) < 20 and hit.mapq > 20


def test_graph_holds_its_reads_and_no_cycle():
    r = random.Random(10)
    source = bases(r, 700)
    reads = []
    for i in range(25):
        at = r.randrange(0, 400)
        s = noisy(r, source[at : at + 300], 0.06)
        reads.append((i, consensus.turned(s) if i % 3 == 1 else s))
    graph, placed, alone = consensus.build([*reads, (90, bases(r, 200))])
    assert alone == [90] and graph.acyclic()
    path = graph.text()
    for i, s in reads:
        number, rev = placed[i]
        assert graph.read(number) == (consensus.turned(s) if rev else s)
        at, ops = graph.script(number)
        out, j = [], at
        for op, n, c in ops:
            out.append(path[j : j + n] if op == "u" else "" if op == "d" else c)
            j += n if op == "u" else op != "i"
        assert "".join(out) == graph.read(number)
    # where many reads lie, the path is nearer to the source than a read is
    middle = path[150:-150]
    far = X.local_score(middle, source, {"a": 1, "b": 1, "q": 0, "e": 1})[0]
    assert far > 0.95 * len(middle)


def test_cigars_as_scripts():
    assert edits.edit_distance is not None
    assert consensus.edits_of_cigar("2S3M1I2M1D1M", "TTACGAGTC", "ACCGTAC") == [("i", 1, "T"), ("i", 1, "T"), ("u", 2, None), ("s", 1, "G"), ("i", 1, "A"), ("u", 2, None), ("d", 1, None), ("u", 1, None)]


def test_archive_on_disk(spark, tmp_path):
    reads = spark.createDataFrame([(i, bases(random.Random(i % 5), 100)) for i in range(20)] + [(50, "")], "read_id bigint, seq string")
    members = spark.createDataFrame([(i, i % 5) for i in range(20)], "node bigint, component bigint")
    contigs, placements, lone, _ = consensus.encode(reads, members)
    archive.write_archive(contigs, placements, lone, str(tmp_path / "a"))
    c, p, s, meta = archive.read_archive(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, consensus.decode(c, p, s).collect())) == sorted(map(tuple, reads.collect()))
    assert (meta.first().contigs, meta.first().reads, meta.first().lone) == (5, 21, 1)
    sizes = {r.stream: r.bytes for r in archive.stream_sizes(spark, str(tmp_path / "a")).collect()}
    assert sizes["all"] == sum(v for k, v in sizes.items() if k != "all") and set(sizes) == {"all", "contigs", "placements", "lone", "metadata"}
    assert "parquet" in {r.extension for r in archive.extensions(spark, str(tmp_path / "a")).collect()}


def test_stored_index(spark, tmp_path):
    reads = spark.createDataFrame([(i, bases(random.Random(i), 300)) for i in range(6)], "read_id bigint, seq string")
    index = sketches.minimizers(reads, 13, 5)
    archive.save_index(index, str(tmp_path / "i"), 4, k=13, w=5)
    back, settings = archive.load_index(spark, str(tmp_path / "i"))
    assert settings["k"] == "13" and sorted(map(tuple, back.select(*index.columns).collect())) == sorted(map(tuple, index.collect()))
    assert sum(archive.load_index(spark, str(tmp_path / "i"), b)[0].count() for b in range(4)) == index.count()
    assert not archive.is_index(spark, str(tmp_path))


def test_parts_combined_and_unpacked(spark, tmp_path):
    rows = [(p, n, f"{p}-{n}") for p in range(3) for n in range(p + 2)]
    archive.combine(spark.createDataFrame(rows, "part int, line_no bigint, value string"), "part", str(tmp_path / "t"))
    back = archive.unpack(files.numbered_lines(spark, str(tmp_path / "t")))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_files_over_several_blocks(spark, tmp_path):
    r = random.Random(11)
    want = [(f"c{i}", bases(r, r.randrange(0, 900))) for i in range(60)]
    text = "".join(f">{n} about\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for n, s in want)
    (tmp_path / "x.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = files.numbered_lines(spark, str(tmp_path / "x.fa"))
        assert [x.value for x in lines.orderBy("line_no").collect()] == text.splitlines() and lines.rdd.getNumPartitions() >= 1
        assert [(x.name, x.seq) for x in files.fasta(spark, str(tmp_path / "x.fa")).orderBy("record").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_mates_and_batches(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"m{k}.fq").write_text("".join(f"@r{i}/{k}\n{'ACGT'[k] * (10 + i)}\n+\n{'I' * (10 + i)}\n" for i in range(5 + k)))
    both = files.interleaved(spark, [str(tmp_path / f"m{k}.fq") for k in (1, 2)])
    assert both.count() == 12 and {x.name for x in both.where("read_id = 2").collect()} == {"r2/1", "r2/2"}
    reads = spark.createDataFrame([(i, f"r{i // 2}/{i % 2 + 1}", "A" * 50) for i in range(40)], "read_id bigint, name string, seq string")
    out = {x.read_id: x.batch for x in files.mini_batches(reads, 300, block=7).collect()}
    assert out == {i: (i // 2 * 100) // 300 for i in range(40)}


def test_simulated_reads_replay(spark):
    source = "".join(x.seq for x in simulation.genome(spark, 25_000, 3).orderBy("chunk").collect())
    assert len(source) == 25_000 and set(source) == set("ACGT")
    for kind in ("const", "exponential", "beta", "mixed"):
        a = simulation.simulated_reads(spark, source, 12, 400, kind, seed=5).collect()
        assert a == simulation.simulated_reads(spark, source, 12, 400, kind, seed=5).collect()
    x = next(y for y in a if not y.is_rc)
    out, at, k = [], x.pos, 0
    import re

    for op, arg in re.findall(r"([uids])(\d+|[ACGT-])", x.edit_string):
        n = int(arg) if op == "u" else 1
        out.append((source + source)[at : at + n] if op == "u" else "" if op == "d" else arg)
        at += 0 if op == "i" else n
        k += 1
    assert "".join(out) == x.seq


def test_simulators_formats(spark, tmp_path):
    (tmp_path / "s.maf").write_text("a\ns chr1 99 6 + 1000 ACG-TAC\ns S1_1 0 6 - 6 ACGGT-C\n\n")
    row = simulation.alignment_blocks(spark, str(tmp_path / "s.maf")).first()
    assert tuple(row) == ("S1_1", "chr1", 99, 105, "-", "ACGGTC")
    named = simulation.named_by_truth(spark.createDataFrame([tuple(row)[:5]], "name string, ctg string, st bigint, en bigint, strand string"))
    assert named.first().name == "S1_1!chr1!99!105!-"
    assert tuple(simulation.truth_of_names(named.select("name")).first())[1:] == ("chr1", 99, 105, "-")
    sam = spark.createDataFrame([("q", 16 + 64, "c", 11, "5M2I3D4M")], "qname string, flag int, rname string, pos int, cigar string")
    assert tuple(simulation.simulated_sam(sam).first()) == ("q", 1, "c", 10, 22, "-")


def test_views(spark):
    h = {"qname": "q", "qlen": 9, "qstart": 1, "qend": 8, "strand": "+", "tname": "t", "tlen": 20, "tstart": 3, "tend": 10, "score": 7, "cigar": "3M1I2M1D1M", "q_seq": "ACGTACG", "t_seq": "ACGATTG"}
    assert views.rows_of(h["cigar"], h["q_seq"], h["t_seq"]) == ("ACG-ATTG", "||| |* |", "ACGTAC-G")
    kinds = "qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int, score int, cigar string, q_seq string, t_seq string"
    df = spark.createDataFrame([tuple(h.values())], kinds)
    text = {f: views.view(df, f).first().text for f in ("pretty", "maf", "cigar")}
    assert "s t 3 7 + 20 ACG-ATTG\ns q 1 7 + 9 ACGTAC-G" in text["maf"] and text["cigar"] == "cigar: q 1 8 + t 3 10 + 7 M 3 I 1 M 2 D 1 M 1" and text["pretty"].startswith("Ref+          4 ACG-ATTG")


def test_unmapped_queries_have_rows(spark):
    hits = spark.createDataFrame([("a", 10, 0, 5, "+", "t", 9, 1, 6, 5, 5, 60, {"tp": "P"})], files.PAF + ", tags map<string,string>")
    out = files.with_unmapped(hits, spark.createDataFrame([("a", 10), ("b", 7)], "qname string, qlen int")).orderBy("qname").collect()
    assert [(x.qname, x.qlen, x.tname) for x in out] == [("a", 10, "t"), ("b", 7, None)]


def test_diagnostics(spark):
    assert diagnostics.memory()["resident"] > 1
    found = diagnostics.codec_benchmark(spark.range(1000).selectExpr("id", "repeat('a', 50) as s"))
    assert found["zstd"]["bytes"] < found["none"]["bytes"]
    said = []
    assert diagnostics.dumped(spark.range(3), "seeds", said.append).count() == 3 and len(said) == 4
    with pytest.raises(ValueError):
        simulation.length_of(np.random.default_rng(1), "none", 5)
