"""Measures of a run: wall and CPU time, memory, codecs, and tables on the way."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import new_path


def memory() -> dict[str, float]:
    """MB of this process: virtual, resident, and the most that was resident."""
    with open("/proc/self/statm") as f:
        pages = [int(x) * resource.getpagesize() / 1e6 for x in f.read().split()[:2]]
    return {"virtual": pages[0], "resident": pages[1], "peak": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3}


@dataclass
class Timer:
    """Wall and CPU seconds of the driver between enter and exit."""

    wall: float = 0.0
    cpu: float = 0.0

    def __enter__(self) -> Timer:
        self._at = time.time(), time.process_time()
        return self

    def __exit__(self, *_) -> None:
        self.wall, self.cpu = time.time() - self._at[0], time.process_time() - self._at[1]


def codec_benchmark(df: DataFrame, codecs: tuple[str, ...] = ("none", "snappy", "zstd")) -> dict[str, dict[str, float]]:
    """Seconds to write and to read df, and bytes on disk, by Parquet codec."""
    spark, out = df.sparkSession, {}
    for codec in codecs:
        path = new_path(spark, f"codec-{codec}")
        with Timer() as write:
            df.write.option("compression", codec).parquet(path)
        with Timer() as read:
            spark.read.parquet(path).write.format("noop").mode("overwrite").save()
        size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0]
        out[codec] = {"write": write.wall, "read": read.wall, "bytes": float(size or 0)}
    return out


def dumped(df: DataFrame, name: str, say: Callable[[str], None], rows: int = 5) -> DataFrame:
    """df as it is; says its schema and a few rows on the way: seeds, chains, hits."""
    say(f"{name}: {df.schema.simpleString()}")
    for r in df.limit(rows).collect():
        say(f"{name}\t" + "\t".join(str(x) for x in r))
    return df
