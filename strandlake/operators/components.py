"""Connected components of an edge table, by label propagation with pointer jumping.

Each round lowers a node's label to the least label among its neighbours, then replaces the label by
its own label. Both steps are a join and a partial aggregate; nothing is collected but the count of
labels that changed. Rounds are written to the shared folder, so lineage stays short; a round's table goes when the next is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.tables import discard, materialize


#: Edges of a task that are reduced at once.
TOGETHER = 1_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the least node of its component, where the two differ."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label = further
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    waiting, size = [], 0
    for batch in batches:
        x, y = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
        waiting.append((x, y))
        size += len(x)
        if size > max(TOGETHER, len(a)):
            a, b = _forest(np.concatenate([a, *(w[0] for w in waiting)]), np.concatenate([b, *(w[1] for w in waiting)]))
            waiting, size = [], 0
    a, b = _forest(np.concatenate([a, *(w[0] for w in waiting)]), np.concatenate([b, *(w[1] for w in waiting)]))
    for k in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], ["a", "b"])


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, without nulls and loops, at most one a node and task: a task keeps a forest of what it has read, whatever the number of its edges."""
    return edges.select("a", "b").where("a is not null and b is not null and a <> b").mapInArrow(_spanning, "a bigint, b bigint")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) for each node of an edge; component is its least node. Edges need not be symmetric or distinct."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = hooked.join(jump, F.col("new") == F.col("at")).select("node", F.col("label").alias("old"), F.least("new", "further").alias("label"))
        moved = materialize(moved, "labels")
        discard(labels)
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            discard(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
