"""Language identification by interpolated Kneser-Ney character models, one a language.

A word is its letters between two blanks; a model gives each character's probability after up to
ORDER - 1 characters of the word. Counts are Kneser-Ney continuation counts below the top order, with
one absolute discount an order from the counts of counts. A model is, for each order, a sorted array
of 64-bit n-gram hashes with the probability mass of the n-gram and, for each context, the weight of
the next shorter order; a probability is read by binary search. The language of a text has the lowest
cross-entropy a character.

Rejection: every fifth sample text of a language is kept out of its model. Of the cross-entropies of
those, the quantile 1 - REJECT_RATE and their spread give the language's limit, MARGIN spreads above
the quantile: a text whose cross-entropy with its best language passes it is marked `rejected`. Its
prediction stays the best language, at half the score.

Models are fitted on a bounded sample of labelled rows, SAMPLE_DOCS of each language, in the order of
a hash; whole texts, however long. A language's sample meets in one task, which fits its model; texts
never reach the driver, which sees a count and a model of a few MB for each language. What is
broadcast grows with the number of languages, not with the rows.

Edge cases: a letter is a character of a Unicode category L; numerals such as one half or superscripts
are none. A text that is null or has no letter is `und` with score 0. With no labelled row, every
text is `und`. Ties go to the language first in order. Empty tables give empty results.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 5
SAMPLE_DOCS = 400
REJECT_RATE, MARGIN = 0.01, 3.0
REMEMBERED = 600_000
UNKNOWN = "und"

#: What \w takes besides letters, decimal digits and the underscore: numerals of other kinds.
_NUMERALS = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("No", "Nl"))
_HELD_NUMERALS, _BLANKED = frozenset(_NUMERALS), dict.fromkeys(map(ord, _NUMERALS), " ")
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case. The few texts with numerals of other kinds have them blanked first: a class that leaves them all out makes the pattern several times slower."""
    text = (text or "").lower()
    if not text.isascii() and not _HELD_NUMERALS.isdisjoint(text):
        text = text.translate(_BLANKED)
    return _WORD.findall(text)


def _hash(codes: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of each run of `length` codes; codes: uint64, one row an n-gram."""
    h = np.full(codes.shape[0], length, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            h = (h ^ codes[:, j]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
    return h


class Model:
    """Sorted hash arrays of one language."""

    def __init__(self, words: Counter, order: int = ORDER):
        self.order = order
        grams: list[Counter] = [Counter() for _ in range(order + 1)]
        for word, n in words.items():
            padded = f" {word} "
            for end in range(1, len(padded)):
                grams[order][padded[max(0, end - order + 1) : end + 1]] += n
        # shorter starts of words are kept whole: they have no longer context to continue
        top = grams[order]
        full = Counter({g: n for g, n in top.items() if len(g) == order})
        grams[order] = full
        for k in range(order - 1, 0, -1):
            longer = grams[k + 1]
            c = Counter()
            for g in longer:
                c[g[1:]] += 1
            for g, n in top.items():
                if len(g) == k:
                    c[g] += n
            grams[k] = c
        self.tables = []
        for k in range(1, order + 1):
            counts = grams[k]
            ones = sum(1 for n in counts.values() if n == 1)
            twos = sum(1 for n in counts.values() if n == 2)
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total, kinds = Counter(), Counter()
            for g, n in counts.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            keys = sorted(counts)
            mass = np.array([(counts[g] - discount) / total[g[:-1]] for g in keys])
            contexts = sorted(total)
            back = np.array([discount * kinds[c] / total[c] for c in contexts])
            self.tables.append((*self._sorted(keys, mass, k), *self._sorted(contexts, back, k - 1)))
        self.floor = 1.0 / max(len(grams[1]) + 1, 256)
        self.limit = -np.log2(self.floor)

    @staticmethod
    def _sorted(keys: list[str], values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length == 0:
            return np.zeros(1, np.uint64), values
        codes = np.array([[ord(x) for x in k] for k in keys], np.uint64).reshape(-1, length)
        h = _hash(codes, length)
        at = np.argsort(h, kind="stable")
        return h[at], values[at]

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(h), missing)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], missing)

    def entropies(self, codes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last code of each row after those before it; depth: codes in use."""
        p = np.full(len(codes), self.floor)
        for k in range(1, self.order + 1):
            keys, mass, contexts, back = self.tables[k - 1]
            use = depth >= k
            rows = codes[use, self.order - k :]
            m = self._look(keys, mass, _hash(rows, k), 0.0)
            b = np.full(len(rows), back[0]) if k == 1 else self._look(contexts, back, _hash(rows[:, :-1], k - 1), 1.0)
            p[use] = m + b * p[use]
        return -np.log2(np.maximum(p, 1e-12))


class Identifier:
    """Models of all languages, with a bounded store of words and their entropies."""

    def __init__(self, models: dict[str, Model]):
        self.names, self.models = sorted(models), [models[n] for n in sorted(models)]
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.models) + 1))

    def __getstate__(self):
        return {"names": self.names, "models": self.models}

    def __setstate__(self, state):
        self.names, self.models = state["names"], state["models"]
        self.index, self.rows = {}, np.zeros((1024, len(self.models) + 1))

    def learn(self, words: list[str]) -> None:
        """Puts the words' characters (letters and the blank that ends a word) and entropies into the store."""
        order = self.models[0].order
        lengths = np.array([len(w) + 1 for w in words])
        flat = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        inside = np.arange(int(lengths.sum())) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + 1
        ends = np.repeat(starts, lengths) + inside
        depth = np.minimum(inside + 1, order)
        codes = flat[np.maximum(ends[:, None] + np.arange(-order + 1, 1)[None, :], 0)]
        # each distinct n-gram is looked up once, however many words hold it
        codes[np.arange(order)[None, :] < order - depth[:, None]] = 0
        _, once, again = np.unique(_hash(codes, order), return_index=True, return_inverse=True)
        codes, depth = codes[once], depth[once]
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        need = len(self.index) + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        first = len(self.index)
        self.rows[first:need, 0] = lengths
        for j, model in enumerate(self.models):
            self.rows[first:need, j + 1] = np.add.reduceat(model.entropies(codes, depth)[again], at)
        self.index.update(zip(words, range(first, need), strict=True))

    def sums(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text its characters, then its bits by language; None without a letter. New words of all texts are learnt at once."""
        found = [words_of(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self.index, self.rows = {}, np.zeros((1024, len(self.models) + 1))
        new: set[str] = set()
        for words in found:
            new.update(words)
        index = self.index
        if new := sorted(w for w in new if w not in index):
            for first in range(0, len(new), 100_000):
                self.learn(new[first : first + 100_000])
        return [self.rows[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(0) if words else None for words in found]

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """For each text: language, score, cross-entropy in bits a character, rejected."""
        return [self._decide(s) for s in (self.sums(texts) if self.models else [None] * len(texts))]

    def _decide(self, sums: np.ndarray | None) -> tuple[str, float, float | None, bool]:
        if sums is None:
            return UNKNOWN, 0.0, None, True
        bits = sums[1:] / sums[0]
        best = int(np.argmin(bits))
        # posterior of the best language, from bits of at most 64 characters: longer texts add no certainty
        score = float(1 / np.exp2(-(bits - bits[best]) * min(sums[0], 64.0)).sum())
        rejected = bool(bits[best] > self.models[best].limit)
        return self.names[best], score / 2 if rejected else score, float(bits[best]), rejected


def fit(texts: list[str], order: int = ORDER) -> Model | None:
    """The model of one language, its limit from the texts kept out of it; None without a letter."""
    words = [words_of(t) for t in texts]
    own = Counter(w for j, found in enumerate(words) if len(texts) < 10 or j % 5 != 4 for w in found)
    if not own:
        return None
    model = Model(own, order)
    sums = [s for s in Identifier({"": model}).sums([t for j, t in enumerate(texts) if j % 5 == 4]) if s is not None and s[0] >= 40]
    if len(sums) >= 2:
        bits = np.array([s[1] / s[0] for s in sums])
        model.limit = float(np.quantile(bits, 1 - REJECT_RATE) + MARGIN * max(bits.std(), 0.05))
    return model


def train(rows: list[tuple[str, str]], order: int = ORDER) -> Identifier:
    """rows: (language, text)."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text)
    return Identifier({lang: m for lang, t in texts.items() if (m := fit(t, order)) is not None})


def models_of(docs: DataFrame) -> Identifier:
    """Models from SAMPLE_DOCS labelled texts of each language, with crc32(doc_id) mod 4 not 2."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(~_held_out())
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return Identifier({})
    # each language at the rate that gives somewhat more than its share, cut in its task in the hash's order
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 40))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.3 * SAMPLE_DOCS + 40) / r["count"]) * float(1 << 40)) for r in counts], "lang string, below double")
    drawn = labelled.select("lang", "text", "doc_id", order.alias("o")).join(F.broadcast(rates), "lang").where("o < below").select("lang", "text", "doc_id", "o")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("o", "doc_id", "text")], strict=True))[:SAMPLE_DOCS]
        model = fit([t for _, _, t in rows])
        return pa.table({"lang": table.column("lang")[:1].cast(pa.string()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    found = drawn.groupBy("lang").applyInArrow(run, "lang string, model binary").collect()
    return Identifier({r["lang"]: m for r in found if (m := pickle.loads(r["model"])) is not None})


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def language_id(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, bits (a character), rejected."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(models_of(docs.withColumn("lang", F.col("lang").cast("string")).select("doc_id", "text", "lang")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = own.identify(batch.column("text").to_pylist())
            columns = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "bits", "rejected"])

    own = docs.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    return own.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double, bits double, rejected boolean")
