"""Rules over the hits, chains and seeds of queries: ranking, joining, pairing, filtering. All are DataFrame plans; windows run within one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of joining chains over long gaps.
JOIN_LONG, JOIN_SHORT, JOIN_FLANK_SCORE, JOIN_FLANK_RATIO = 20_000, 2_000, 1_000, 0.5


def _running(order, last: int = 0):
    return order.rowsBetween(Window.unboundedPreceding, last)


def joined_long(chains: DataFrame, longest: int = JOIN_LONG, shortest: int = JOIN_SHORT, flank_score: int = JOIN_FLANK_SCORE, flank_ratio: float = JOIN_FLANK_RATIO) -> DataFrame:
    """chains: q, id, t, rev, score, n, qs, qe, ts, te. Neighbours in query order that go on along one target and strand over a long gap are one chain: (q, id, t, rev, parts, score, n, qs, qe, ts, te)."""
    order = Window.partitionBy("q").orderBy("qs", "qe", "id")
    last = {c: F.lag(c).over(order) for c in ("t", "rev", "score", "qs", "qe", "ts", "te")}
    gap_q, gap_t = F.col("qs") - last["qe"], F.col("ts") - last["te"]
    wide, narrow = F.greatest(gap_q, gap_t), F.least(gap_q, gap_t)
    need_score, need_len = F.floor(wide * flank_score / longest + 0.499), F.floor(wide * flank_ratio)
    ends = [F.col("te") - F.col("ts"), F.col("qe") - F.col("qs"), last["te"] - last["ts"], last["qe"] - last["qs"]]
    goes_on = (last["t"] == F.col("t")) & (last["rev"] == F.col("rev")) & (gap_q > 0) & (gap_t > 0) & (wide <= longest) & (narrow <= shortest)
    goes_on = goes_on & (F.least("score", last["score"]) >= need_score) & (F.least(*ends) >= need_len)
    flagged = chains.withColumn("new", F.when(goes_on, 0).otherwise(1))
    named = flagged.withColumn("island", F.sum("new").over(_running(order)))
    total = lambda c: F.sum(c).alias(c)
    out = named.groupBy("q", "island").agg(F.min_by("id", "qs").alias("id"), F.first("t").alias("t"), F.first("rev").alias("rev"), F.count("*").alias("parts"), total("score"), total("n"), F.min("qs").alias("qs"), F.max("qe").alias("qe"), F.min("ts").alias("ts"), F.max("te").alias("te"))
    return out.drop("island")


def resynced(hits: DataFrame) -> DataFrame:
    """hits: q, id, parent. Ids are numbered anew from 0 in order, and parents follow; a hit whose parent is gone is its own."""
    numbered = hits.withColumn("new_id", F.row_number().over(Window.partitionBy("q").orderBy("id")) - 1)
    up = numbered.select(F.col("q").alias("up_q"), F.col("id").alias("up_id"), F.col("new_id").alias("new_parent"))
    met = numbered.join(up, (F.col("q") == F.col("up_q")) & (F.col("parent") == F.col("up_id")), "left")
    return met.select("q", "id", "new_id", F.coalesce("new_parent", "new_id").alias("new_parent"))


def longest_stretch(anchors: DataFrame) -> DataFrame:
    """anchors: chain, qpos, rpos, span. The run of anchors without a gap between them that scores most: (chain, first, anchors, score)."""
    order = Window.partitionBy("chain").orderBy("rpos", "qpos")
    dq, dr = F.col("qpos") - F.lag("qpos").over(order), F.col("rpos") - F.lag("rpos").over(order)
    flagged = anchors.withColumn("at", F.row_number().over(order) - 1).withColumn("new", F.when(dq == dr, 0).otherwise(1)).withColumn("gain", F.when(dq == dr, F.least(dq, F.col("span"))).otherwise(F.col("span")))
    runs = flagged.withColumn("run", F.sum("new").over(_running(order))).groupBy("chain", "run").agg(F.min("at").alias("first"), F.count("*").alias("anchors"), F.sum("gain").alias("score"))
    best = Window.partitionBy("chain").orderBy(F.desc("score"), "first")
    return runs.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("chain", "first", "anchors", "score")


def inversion_quality(hits: DataFrame) -> DataFrame:
    """hits: q, id, t, ts, mapq, inv. An inversion's quality is the lesser of its neighbours' along the targets, 0 at an end."""
    order = Window.partitionBy("q").orderBy("t", "ts", "id")
    both = F.coalesce(F.least(F.lag("mapq").over(order), F.lead("mapq").over(order)), F.lit(0))
    inside = F.lag("mapq").over(order).isNotNull() & F.lead("mapq").over(order).isNotNull()
    return hits.withColumn("mapq", F.when(F.col("inv"), F.when(inside, both).otherwise(0)).otherwise(F.col("mapq")))


def first_primary(hits: DataFrame) -> DataFrame:
    """hits: q, id, parent. sam_pri: the first of a query's primary hits."""
    primary = F.col("id") == F.col("parent")
    first = F.min(F.when(primary, F.col("id"))).over(Window.partitionBy("q"))
    return hits.withColumn("sam_pri", F.coalesce(primary & (F.col("id") == first), F.lit(False)))


def alternative_score(score: Column, is_alt: Column, drop: float = 0.15) -> Column:
    """Scores on alternative contigs lose a share where hits are ranked."""
    return F.when(is_alt, F.floor(score * (1 - drop) + 0.499)).otherwise(score).cast("bigint")


def hit_order(hits: DataFrame, alternatives: DataFrame, drop: float = 0.15) -> DataFrame:
    """hits: q, id, t, score; alternatives: t. Rank by score, less on alternative contigs; equal ones by a hash, then id."""
    marked = hits.join(alternatives.select("t").distinct().withColumn("is_alt", F.lit(True)), "t", "left").withColumn("is_alt", F.coalesce("is_alt", F.lit(False)))
    ranked = marked.withColumn("used", alternative_score(F.col("score"), F.col("is_alt"), drop))
    best = Window.partitionBy("q").orderBy(F.desc("used"), F.md5(F.col("id").cast("string")), "id")
    return ranked.select("q", "id", "t", "is_alt", "used", (F.row_number().over(best) - 1).alias("rank"))


def base_mapping_quality(h: dict[str, Column], match: int = 2, least_chain: int = 40, short: bool = False) -> Column:
    """Mapping quality of primary hits with base alignments. h: score, score0, subsc, n, dp_max, dp_max2, mlen, blen, n_sub, sum_score, rep_len."""
    unique = h["sum_score"] / (h["sum_score"] + h["rep_len"])
    by_score = F.least(F.lit(1.0), 0.01 * h["score"]) * unique
    trust = F.least(by_score, F.when(h["n"] > 10, 1.0).otherwise(0.1 * h["n"]))
    second = F.greatest(h["subsc"], F.lit(least_chain))
    identity = h["mlen"] / h["blen"]
    x = h["dp_max2"] * second / h["dp_max"] / h["score0"]
    rated = F.floor(identity * trust * 40 * (1 - x * x) * F.ln(h["dp_max"] / match))
    if not short:
        rated = F.least(rated, F.floor(6.02 * identity * identity * (h["dp_max"] - h["dp_max2"]) / match + 0.499))
    plain = F.floor(identity * trust * 40 * (1 - second / h["score0"]) * F.ln(h["dp_max"] / match))
    raw = F.when((h["dp_max2"] > 0) & (h["dp_max"] > 0), rated).otherwise(plain) - F.floor(4.343 * F.ln(h["n_sub"] + 1) + 0.499)
    cut = F.least(F.lit(60), F.greatest(F.lit(0), raw))
    return F.when((cut == 0) & (h["dp_max"] > h["dp_max2"]), 1).otherwise(cut).cast("int")


def kept_hits(hits: DataFrame, least_n: int, least_match: int, least_score: int, clip: float) -> DataFrame:
    """hits: n, mlen, dp_max, qs, qe, qlen. Without hits of few anchors, few matches, a low score, or more than a share of the query clipped at both ends."""
    both = (F.col("qs") > clip * F.col("qlen")) & (F.col("qlen") - F.col("qe") > clip * F.col("qlen"))
    return hits.where((F.col("n") >= least_n) & (F.col("mlen") >= least_match) & (F.col("dp_max") >= least_score) & ~both)


def pairs(first: DataFrame, second: DataFrame, gap: int, bonus: int) -> DataFrame:
    """Of each fragment, the best pair of hits of its two ends on one target, on opposite strands and facing, at most `gap` apart. Both: q, id, t, rev, ts, te, score. Out: q, a, b, score, others (pairs within bonus of it)."""
    a = first.select("q", *[F.col(c).alias(f"a_{c}") for c in ("id", "t", "rev", "ts", "te", "score")])
    b = second.select("q", *[F.col(c).alias(f"b_{c}") for c in ("id", "t", "rev", "ts", "te", "score")])
    # the strand of the second end is turned: a proper pair has one on each
    left = lambda x: F.when(F.col("a_rev") == 0, F.col(f"a_{x}")).otherwise(F.col(f"b_{x}"))
    right = lambda x: F.when(F.col("a_rev") == 0, F.col(f"b_{x}")).otherwise(F.col(f"a_{x}"))
    met = a.join(b, (a["q"] == b["q"]) & (a["a_t"] == b["b_t"]) & (a["a_rev"] != b["b_rev"])).drop(b["q"])
    met = met.where((left("ts") <= right("ts")) & (right("ts") - left("te") <= gap)).withColumn("score", F.col("a_score") + F.col("b_score"))
    tops = first.groupBy("q").agg(F.max("score").alias("top_a")).join(second.groupBy("q").agg(F.max("score").alias("top_b")), "q")
    good = met.join(tops, "q").where(F.col("score") >= F.greatest(F.col("top_a") + F.col("top_b") - bonus, F.lit(0)))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "a_id", "b_id")
    every = Window.partitionBy("q")
    ranked = good.withColumn("rn", F.row_number().over(best)).withColumn("top", F.max("score").over(every))
    ranked = ranked.withColumn("others", (F.count_if(F.col("score") + bonus >= F.col("top")).over(every) - 1))
    return ranked.where("rn = 1").select("q", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score", "others")


def read_through(first: DataFrame, second: DataFrame) -> DataFrame:
    """Fragments whose two ends each have one primary hit, at the same place: the fragment is shorter than its reads. Both: q, t, rev, ts, te, qs, qe, qlen."""
    one = lambda df, p: df.groupBy("q").agg(F.count("*").alias(f"{p}n"), *[F.first(c).alias(f"{p}{c}") for c in ("t", "rev", "ts", "te", "qs", "qe", "qlen")]).where(f"{p}n = 1")
    met = one(first, "a_").join(one(second, "b_"), "q")
    same = (F.col("a_t") == F.col("b_t")) & (F.col("a_rev") == F.col("b_rev")) & (F.abs(F.col("a_ts") - F.col("b_ts")) < 3) & (F.abs(F.col("a_te") - F.col("b_te")) < 3)
    whole = ((F.col("a_qs") == 0) & (F.col("b_qe") == F.col("b_qlen"))) | ((F.col("b_qs") == 0) & (F.col("a_qe") == F.col("a_qlen")))
    return met.where(same & whole).select("q")


def by_segment(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """anchors: frag, qpos (on the segments laid end to end), rpos; segments: frag, seg, len. Anchors with their segment and the place on it."""
    order = Window.partitionBy("frag").orderBy("seg")
    placed = segments.withColumn("from", F.coalesce(F.sum("len").over(_running(order, -1)), F.lit(0))).withColumnRenamed("frag", "f")
    met = anchors.join(placed, (F.col("frag") == F.col("f")) & (F.col("qpos") >= F.col("from")) & (F.col("qpos") < F.col("from") + F.col("len")))
    return met.select("frag", "seg", (F.col("qpos") - F.col("from")).alias("seg_pos"), "rpos")


def merged_parts(parts: list[DataFrame], shifts: list[int], best_n: int) -> DataFrame:
    """Hits of one set of queries against the parts of an index (q, rid, score): one list a query, target numbers moved on by each part's shift, the best_n best."""
    moved = [p.select("q", (F.col("rid") + s).alias("rid"), "score") for p, s in zip(parts, shifts, strict=True)]
    every = moved[0]
    for m in moved[1:]:
        every = every.unionByName(m)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rid")
    return every.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < best_n)


def fuzzy_lengths(anchors: DataFrame) -> DataFrame:
    """anchors: chain, qpos, rpos, span (places of their last bases). A chain's coordinates, and the bases that its anchors cover: (chain, qs, qe, rs, re, mlen, blen)."""
    order = Window.partitionBy("chain").orderBy("rpos", "qpos")
    dq, dr = F.col("qpos") - F.lag("qpos").over(order), F.col("rpos") - F.lag("rpos").over(order)
    span = F.col("span")
    stepped = anchors.select("chain", "qpos", "rpos", "span", F.coalesce(F.greatest(dq, dr), span).alias("block"), F.coalesce(F.when((dq > span) & (dr > span), span).otherwise(F.least(dq, dr)), span).alias("match"))
    return stepped.groupBy("chain").agg((F.min_by("qpos", F.struct("rpos", "qpos")) + 1 - F.min_by("span", F.struct("rpos", "qpos"))).alias("qs"), (F.max_by("qpos", F.struct("rpos", "qpos")) + 1).alias("qe"), (F.min_by("rpos", F.struct("rpos", "qpos")) + 1 - F.min_by("span", F.struct("rpos", "qpos"))).alias("rs"), (F.max("rpos") + 1).alias("re"), F.sum("match").cast("bigint").alias("mlen"), F.sum("block").cast("bigint").alias("blen"))


def repeat_length(minimizers: DataFrame, k: int, most: int) -> DataFrame:
    """minimizers: read_id, pos, minimizer. Bases of each read under minimizers that occur `most` times or more: (read_id, rep_len)."""
    counts = minimizers.groupBy("minimizer").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("minimizer")
    often = minimizers.join(counts, "minimizer", "left_semi").select("read_id", F.col("pos").alias("st"), (F.col("pos") + k).alias("en"))
    order = Window.partitionBy("read_id").orderBy("st", "en")
    reach = F.max("en").over(_running(order, -1))
    return often.withColumn("more", F.greatest(F.col("en") - F.greatest("st", F.coalesce(reach, F.col("st"))), F.lit(0))).groupBy("read_id").agg(F.sum("more").cast("bigint").alias("rep_len"))


def seed_rules(anchors: DataFrame, diagonal: bool = True, dual: bool = True, strand: str = "both") -> DataFrame:
    """anchors: query_id, read_id, rev, query_pos, ref_pos of reads against themselves. Without a read's own diagonal, with each pair of reads once, on one strand only, as asked."""
    out = anchors
    if not diagonal:
        out = out.where(~((F.col("query_id") == F.col("read_id")) & (F.col("query_pos") == F.col("ref_pos")) & (F.col("rev") == 0)))
    if not dual:
        out = out.where(F.col("query_id") <= F.col("read_id"))
    return out if strand == "both" else out.where(F.col("rev") == (0 if strand == "forward" else 1))


def unmasked(minimizers: DataFrame, masks: DataFrame, k: int) -> DataFrame:
    """minimizers: read_id, pos; masks: read_id, st, en, not overlapping. Without minimizers of which masks cover more than half."""
    lists = masks.groupBy("read_id").agg(F.collect_list(F.struct("st", "en")).alias("m"))
    under = F.aggregate(F.coalesce("m", F.array().cast("array<struct<st:int,en:int>>")), F.lit(0), lambda acc, x: acc + F.greatest(F.least(x["en"], F.col("pos") + k) - F.greatest(x["st"], F.col("pos")), F.lit(0)))
    return minimizers.join(lists, "read_id", "left").where(under <= k // 2).drop("m")


def overlap_sensitivity(mapped: DataFrame, predicted: DataFrame, least: int, width: int) -> DataFrame:
    """mapped: name, ctg, st, en; predicted: a, b. Overlaps of at least `least` that mappings imply, and how many predictions miss: (overlaps, missing, sensitivity)."""
    from .intervals import overlap_join

    met = overlap_join(mapped, mapped, ["ctg"], width).where("name < b_name")
    long = met.where(F.least("en", "b_en") - F.greatest("st", "b_st") >= least).select(F.col("name").alias("a"), F.col("b_name").alias("b")).distinct()
    known = predicted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("hit", F.lit(1))
    return long.join(known, ["a", "b"], "left").agg(F.count("*").alias("overlaps"), F.count_if(F.col("hit").isNull()).alias("missing"), (F.count("hit") / F.count("*")).alias("sensitivity"))
