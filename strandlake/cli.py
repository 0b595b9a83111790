"""Command line: python -m strandlake.cli map|convert|query ...; see --help."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.mapping import map_reads
from strandlake.plans import catalog
from strandlake.plans.presets import PRESETS
from strandlake.sources import converters, files

CONVERSIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "delta2paf": converters.delta_to_paf,
    "sam2paf": lambda spark, path: converters.sam_to_paf(*files.sam(spark, path)),
    "gff2bed": lambda spark, path: converters.annotations_to_bed(converters.annotations(spark, path)),
    "splice2bed": lambda spark, path: converters.splice_to_bed(files.paf(spark, path).withColumn("cigar", F.try_element_at("tags", F.lit("cg")))),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandlake")
    kinds = out.add_subparsers(dest="command", required=True)
    m = kinds.add_parser("map", help="map reads to targets, as SAM text or a Parquet table")
    m.add_argument("queries")
    m.add_argument("targets")
    m.add_argument("out")
    m.add_argument("--preset", choices=sorted(PRESETS), default="map-ont")
    m.add_argument("--sam", action="store_true")
    c = kinds.add_parser("convert", help="rows of another format, tab separated")
    c.add_argument("kind", choices=sorted(CONVERSIONS))
    c.add_argument("path")
    c.add_argument("out")
    q = kinds.add_parser("query", help="a named query over a folder of tables, as Parquet")
    q.add_argument("name", choices=sorted(catalog.QUERIES))
    q.add_argument("tables")
    q.add_argument("out")
    return out


def main(spark: SparkSession, words: list[str] | None = None) -> None:
    a = parser().parse_args(words)
    if a.command == "query":
        catalog.QUERIES[a.name](spark, a.tables).write.parquet(a.out)
    elif a.command == "convert":
        CONVERSIONS[a.kind](spark, a.path).write.option("sep", "\t").csv(a.out)
    else:
        queries, targets = (files.sequences(spark, p).select("read_id", "seq") for p in (a.queries, a.targets))
        hits = map_reads(queries, targets, PRESETS[a.preset], same_ids=a.queries == a.targets)
        if a.sam:
            converters.write_sam(hits, queries, targets, a.out)
        else:
            hits.write.parquet(a.out)


if __name__ == "__main__":
    main(SparkSession.builder.appName("strandlake").getOrCreate())
