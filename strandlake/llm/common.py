"""What the operators of this subpackage share: table access, shared folders, native helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.tables import discard, forget, give_back, materialize, new_path, shared_dir

__all__ = ["SPACES", "discard", "forget", "give_back", "let", "materialize", "new_path", "resource_sum", "shared_dir", "table", "words_of"]

#: Words are runs of anything but a blank and the ASCII controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body, or a lambda in it, uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def resource_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


