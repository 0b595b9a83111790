"""The command line, SAM files, and windows over a stream."""

import datetime as dt
import random

from strandlake import cli
from strandlake.sources import files
from strandlake.streaming import reads as streams


def test_map_to_sam_and_convert(spark, tmp_path):
    r = random.Random(3)
    genome = "".join(r.choice("ACGT") for _ in range(2000))
    (tmp_path / "q.fastq").write_text("".join(f"@r{k}\n{genome[k * 500 : k * 500 + 600]}\n+\n{'I' * 600}\n" for k in range(3)))
    (tmp_path / "t.fastq").write_text(f"@g\n{genome}\n+\n{'I' * 2000}\n")
    # targets and queries are files of their own, and read ids count from 0 in each
    cli.main(spark, ["map", str(tmp_path / "q.fastq"), str(tmp_path / "t.fastq"), str(tmp_path / "sam"), "--sam"])
    rows, lengths = files.sam(spark, str(tmp_path / "sam"))
    assert [(x.name, x.length) for x in lengths.collect()] == [("0", 2000)]
    got = {x.qname: x for x in rows.collect()}
    assert set(got) == {"0", "1", "2"}
    for k in (0, 1, 2):
        clip = int(got[str(k)].cigar.split("S")[0]) if "S" in got[str(k)].cigar.split("M")[0] else 0
        assert got[str(k)].pos - 1 - clip == k * 500 and got[str(k)].tags["NM"] == "0"
    cli.main(spark, ["convert", "sam2paf", str(tmp_path / "sam"), str(tmp_path / "paf")])
    assert spark.read.text(str(tmp_path / "paf")).count() == 3


def test_windowed_counts_of_a_stream(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(at(0, 5), "a"), (at(0, 59), "a"), (at(1, 0), "a"), (at(1, 30), "b")]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert sorted((x.st, x.event_type, x.n) for x in spark.table("counts").collect()) == [(at(0, 0), "a", 2), (at(1, 0), "a", 1), (at(1, 0), "b", 1)]
