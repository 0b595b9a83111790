"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains). Expectation-maximisation over the counts of
distinct vote patterns (at most 3 ** len(RULES), whatever the number of documents) estimates the
share of good documents and each rule's accuracy (its chance of each vote from good and from bad
documents, from Dirichlet priors of WEIGHT documents); a document's posterior probability of being
good replaces the usual all-rules-must-pass filter. A rule that other rules don't bear out is found
to be noise, and its lone bad vote rejects nothing.

Plan: one scan computes the features of every row in its own row (no explode, no shuffle of text),
writes them to the shared folder, and a partial aggregate shuffles only vote patterns.

Edge cases: a null text has no words, so it fails the base rule. Empty tables give empty results.
Repeated rows are judged each on its own. Very long texts cost n log n in their words. Repeated
three-word windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, resource_sum, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 60
#: The share of good documents before any is seen.
PRIOR = 0.85
#: Chances of the votes of a rule, where EM starts; they count as WEIGHT documents in each round.
VOTES, WEIGHT = (-1, 0, 1), 20.0
FROM_GOOD, FROM_BAD = (0.01, 0.49, 0.5), (0.3, 0.35, 0.35)
#: The same for the rules that only vote -1 or abstain.
ONE_SIDED = ("repeats", "duplicate_lines", "symbols", "capitals", "shouting")
ONE_FROM_GOOD, ONE_FROM_BAD = (0.01, 0.99, 0.0), (0.3, 0.7, 0.0)
KEEP_FROM = 0.5


def _repeat_words(words: Column) -> Column:
    """Words within three-word windows found at least twice, the first included."""

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i + 1 < n) & (F.get(s, i + 1)["h"] == e["h"])))
            return let(F.array_sort(F.transform(twice, lambda e: e["i"])), lambda p: resource_sum(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(pairs, spans))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(windows, covered))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column f of counts, made in one pass over each text."""

    def counts(words: Column) -> Column:
        t = F.coalesce(F.col(text), F.lit(""))
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        joined = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(joined).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
            F.regexp_count(t, F.lit(r"[\p{L}\p{N}][.,;:!?)\"']?(?=[\x20\x09-\x0D]|\z)")).cast("bigint").alias("n_ended"),
            F.regexp_count(joined, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
            F.regexp_count(joined, F.lit(r"[!?]{2,}")).cast("bigint").alias("n_shouts"),
            let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
        )

    return docs.withColumn("f", let(words_of(F.coalesce(F.col(text), F.lit(""))), counts))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(f: Column) -> dict[str, Column]:
    """Rules over the features; each votes on its own ground only and abstains elsewhere: most know junk when they see it and say nothing of other texts."""
    n, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))
    mean, never = chars / n, F.lit(False)
    return {
        "length": _vote(f["n_words"] < MIN_WORDS, f["n_words"] >= 60),
        "repeats": _vote(100 * f["n_repeat_words"] > 45 * n, never),
        "duplicate_lines": _vote((f["lines"]["n"] >= 4) & (100 * f["lines"]["dup"] > 50 * f["lines"]["n"]), never),
        "symbols": _vote(100 * f["n_symbols"] > 5 * chars, never),
        "mean_word": _vote((mean < 2.5) | (mean > 14), (mean >= 3.5) & (mean <= 10)),
        "variety": _vote(100 * f["n_distinct"] < 15 * F.least(n, F.lit(1000)), 100 * f["n_distinct"] >= 30 * n),
        "capitals": _vote(100 * f["n_upper"] > 40 * chars, never),
        "shouting": _vote(100 * f["n_shouts"] > 20 * n, never),
        "endings": _vote(100 * f["n_ended"] < 70 * n, 100 * f["n_ended"] >= 85 * n),
    }


RULES = ("length", "repeats", "duplicate_lines", "symbols", "mean_word", "variety", "capitals", "shouting", "endings")


def _posterior(votes: Column, p: Column) -> Column:
    """Probability of a good document; p: the prior, then for each rule the chances of votes -1, 0, 1 from good and from bad documents."""
    terms = [F.log(F.get(p, F.lit(0)) / (1 - F.get(p, F.lit(0))))]
    for j in range(len(RULES)):
        at = F.get(votes, F.lit(j)) + (2 + 6 * j)
        terms.append(F.log(F.get(p, at) / F.get(p, at + 3)))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def chances(p: list[float]) -> dict[str, tuple[list[float], list[float]]]:
    """What estimate() found, by rule: chances of the votes -1, 0, 1 from good and from bad documents; each three add up to 1."""
    return {name: (p[1 + 6 * j : 4 + 6 * j], p[4 + 6 * j : 7 + 6 * j]) for j, name in enumerate(RULES)}


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """Prior and vote chances by EM over the vote patterns: one row, one expression."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("c"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "c"))).alias("rows"))
    zero = F.lit(0.0)
    starts = [(ONE_FROM_GOOD, ONE_FROM_BAD) if name in ONE_SIDED else (FROM_GOOD, FROM_BAD) for name in RULES]

    def total(rows: Column, of) -> Column:
        return F.aggregate(rows, zero, lambda a, r: a + of(r))

    def step(p: Column, _: Column) -> Column:
        def update(rows: Column) -> Column:
            every, good = total(rows, lambda r: r["c"]), total(rows, lambda r: r["c"] * r["q"])
            new = [F.least(F.greatest((good + WEIGHT * PRIOR) / (every + WEIGHT), F.lit(0.05)), F.lit(0.95))]
            for j, (from_good, from_bad) in enumerate(starts):
                seen = lambda v, of, j=j: total(rows, lambda r: F.when(F.get(r["votes"], F.lit(j)) == v, of(r)).otherwise(zero))
                chances = [(seen(v, lambda r: r["c"] * r["q"]) + WEIGHT * x) / (good + WEIGHT) for v, x in zip(VOTES, from_good, strict=True)]
                chances += [(seen(v, lambda r: r["c"] * (1 - r["q"])) + WEIGHT * x) / (every - good + WEIGHT) for v, x in zip(VOTES, from_bad, strict=True)]
                new += chances
            return F.array(*new)

        return let(F.transform(F.col("rows"), lambda r: F.struct(r["votes"].alias("votes"), r["c"].alias("c"), _posterior(r["votes"], p).alias("q"))), update)

    start = F.array(*[F.lit(float(x)) for x in (PRIOR, *[x for good, bad in starts for x in (*good, *bad)])])
    return list(one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("p")).first()["p"])


def judge(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM, keep_text: bool = False) -> DataFrame:
    """docs, with features f, votes, base_failed, p_good and kept, as a table in the shared folder; the text stays in it only on demand."""
    made = features(docs, text)
    f = F.col("f")
    made = made.withColumn("votes", F.array(*[F.coalesce(v, F.lit(0)) for v in rules(f).values()]))
    made = made.withColumn("base_failed", (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]))
    made = materialize(made if keep_text else made.drop(text), "quality-rules")
    p = estimate(made)
    good = _posterior(F.col("votes"), F.array(*[F.lit(x) for x in p]))
    return made.withColumn("p_good", good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The digest of judge(): one row for each row of docs (doc_id, text)."""
    judged = judge(docs.select("doc_id", "text"))
    f = F.col("f")
    return judged.select("doc_id", f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"), f["lines"]["dup"].alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words"), "base_failed", "kept", "p_good")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, in the columns of docs."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("text"))
    return judge(packed).where("kept").select(*[F.col("row")[c].alias(c) for c in own])
