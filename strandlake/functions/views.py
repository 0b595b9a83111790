"""Alignments as text: base over base, multiple alignment blocks, and one line a hit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairwise import walk


def rows_of(cigar: str, query: str, target: str) -> tuple[str, str, str]:
    """The target's row, the signs between, and the query's row."""
    t, m, q = [], [], []
    for op, a, b in walk(cigar, query, target):
        n = max(len(a), len(b))
        t.append(b or "-" * n)
        q.append(a or ("." if op == "N" else "-") * n)
        m.append(("|" if op == "=" else "*" if op == "X" else " ") * n)
    return "".join(t), "".join(m), "".join(q)


def pretty(cigar: str, query: str, target: str, q_st: int, t_st: int, width: int = 80) -> str:
    """Rows of at most `width` places, each with the place of its first base, from 1."""
    t, m, q = rows_of(cigar, query, target)
    out, i, j = [], q_st, t_st
    for at in range(0, len(t), width):
        a, b, c = t[at : at + width], m[at : at + width], q[at : at + width]
        out += [f"Ref+ {j + 1:>10} {a}", f"{'':>16}{b}", f"Qry+ {i + 1:>10} {c}", ""]
        j, i = j + sum(x != "-" for x in a), i + sum(x not in "-." for x in c)
    return "\n".join(out)


def maf(h: dict) -> str:
    """A block of a multiple alignment file."""
    t, _, q = rows_of(h["cigar"], h["q_seq"], h["t_seq"])
    q_at = h["qstart"] if h["strand"] == "+" else h["qlen"] - h["qend"]
    line = lambda name, st, n, strand, size, text: f"s {name} {st} {n} {strand} {size} {text}"
    return "\n".join(["a", line(h["tname"], h["tstart"], h["tend"] - h["tstart"], "+", h["tlen"], t), line(h["qname"], q_at, h["qend"] - h["qstart"], h["strand"], h["qlen"], q), ""])


def lastz_cigar(h: dict) -> str:
    """One line of places, score and operations."""
    from .pairwise import parse

    q = (h["qstart"], h["qend"]) if h["strand"] == "+" else (h["qend"], h["qstart"])
    return f"cigar: {h['qname']} {q[0]} {q[1]} {h['strand']} {h['tname']} {h['tstart']} {h['tend']} + {h['score']} " + " ".join(f"{op} {n}" for n, op in parse(h["cigar"]))


def view(hits: DataFrame, form: str) -> DataFrame:
    """hits in PAF columns with score, cigar, q_seq (aligned bases on the target's strand) and t_seq: one text a hit. form: pretty, maf or cigar."""
    make = {"pretty": lambda h: pretty(h["cigar"], h["q_seq"], h["t_seq"], h["qstart"], h["tstart"]), "maf": maf, "cigar": lastz_cigar}[form]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([h["qname"] for h in rows], pa.string()), pa.array([make(h) for h in rows], pa.string())], ["qname", "text"])

    return hits.mapInArrow(of, "qname string, text string")


def hit_text(names: list[str]) -> Column:
    """A hit's columns as one tab-separated line."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in names])
