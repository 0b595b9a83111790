"""N-gram Jaccard join, exact, by a size-aware heavy-light scheme, down to its connected components.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one node, so
exact copies meet once, in a partial aggregate. Two nodes link when |A and B| >= t * |A or B|.

Light sets (fewer than BOUNDARY shingles) enumerate their subsets of the sizes that a partner's
overlap can have; partners share a subset. Heavy sets use inverted lists. Lists of single shingles
would hold a third of all documents for a shingle of a common line, so a list's key is a group of
shingles: sizes fall into classes c, c / t, ...; for the pairs whose smaller set is in a class, at
most d shingles differ, so of d + 1 + spare groups (by hash) at least 1 + spare are equal. spare is
SPARE or, where groups are small, more than a set leaves empty but by rare chance: sets with more empty
groups enter lists of empty groups, too, which tie long documents to one candidate group. A document
enters the lists of its own class and of the one below, as the smaller and as the larger partner.
The boundary is where the cost of enumerating subsets passes that of entering and scanning lists.

A linked pair is equal in 1 + spare groups, so a node has at least so many keys of a class (fewer by
the empty groups it doesn't enter) that other nodes have, too: a node with fewer leaves that class's
lists before any pair is made. Unrelated documents with lines in common share a few keys and leave here.
Keys that a sample of nodes shows in more than HOT of all nodes are set aside: their least members come
from partial aggregates, and other keys' lists are short enough for one task each. The sample decides
only which way a key goes; either way gives the same rows.

Lists give stars (member, least member), whose components are the candidate groups: every link lies
within one. Before these are worked out, each node keeps one pair and its other least members are linked
to the same one. Groups are cut into blocks by hash. Round 1 compares within blocks, round 2 all nodes
outside their group's largest component with all blocks of the group: what is linked already needs no
second look, so a huge group of near copies costs about its size, and no link between components is
missed. A comparison scans inverted lists of one block's shingles and counts exactly. A task returns
a spanning forest of its links, never all pairs. No list, group or block is cut short.

Edge cases: null and empty texts have empty sets, which link with nothing; rows that share a doc_id
are one document of several sets; a null doc_id is reported with a null component unless its set
links to another's. Very long texts are sets like others. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.components import connected_components

from .common import discard, forget, materialize

NGRAM, PERCENT = 3, 90
#: Groups of shingles that may be empty in a set without leaving its lists, at least.
SPARE = 2
#: A key in more than this share of the nodes (and SEEN of the sample) is hot; one node in SAMPLE is in the sample.
HOT, SEEN, SAMPLE = 0.001, 20, 64
#: Tasks over which a hot key's nodes are dealt.
SALTS = 64
#: Passes, each over its share of the nodes or of the keys: their shuffle files, and what sorts spill, stand on disk one pass at a time. At least PASSES, and so many that a pass has the keys of at most about PASS_BYTES of text.
PASSES, PASS_BYTES = 4, 400_000_000
#: Nodes in a block of a candidate group.
BLOCK = 400
#: In the cost of lists: what scanning a list costs, before it halves with each shingle in its key.
SCAN = 64

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C[4]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, k: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A to Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(w) < k:
            h = np.array([len(w)], np.uint64)
            for x in w:
                h = _mix(h * _C[0] + x)
            return h
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = _mix(h * _C[0] + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def most_partner(a: int, percent: int = PERCENT) -> int:
    """The largest set that can link with one of a shingles."""
    return a * 100 // percent


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    return -(-percent * (a + b) // (100 + percent))


def differing(a: int, percent: int = PERCENT) -> int:
    """Most shingles in which a set of a and a linked larger one can differ."""
    return max((a + b - 2 * least_overlap(a, b, percent) for b in range(a, most_partner(a, percent) + 1)), default=0)


class Scheme:
    """Boundary, size classes and keys for one threshold."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        n = 2
        while self._light_cost(n) <= self._heavy_cost(n):
            n += 1
        self.boundary = n
        self.starts: list[int] = [n]
        self.groups: dict[int, tuple[int, int]] = {}

    def _light_sizes(self, n: int) -> list[int]:
        """Sizes of the subsets that a set of n enumerates: overlaps with partners up to the boundary."""
        least = -(-self.percent * n // 100)
        return sorted({least_overlap(min(a, n), max(a, n), self.percent) for a in range(least, most_partner(n, self.percent) + 1)} | {n})

    def _light_cost(self, n: int) -> float:
        return sum(math.comb(n, s) for s in self._light_sizes(n) if s <= n)

    def _heavy_cost(self, n: int) -> float:
        groups = 2 * (differing(n, self.percent) + 1 + SPARE)
        return groups * (1 + SCAN / 2 ** max(0.0, 2 * n / groups - 1))

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """(start, groups, spare) of the classes whose lists a heavy set of n enters."""
        while self.starts[-1] <= n:
            self.starts.append(most_partner(self.starts[-1], self.percent) + 1)
        at = max(j for j, s in enumerate(self.starts) if s <= n)
        out = []
        for j in (at - 1, at):
            if j >= 0:
                out.append((self.starts[j], *self._groups(j)))
        return out

    def _groups(self, j: int) -> tuple[int, int]:
        """Groups of a class, worked out once: the most shingles that differ, 1, and the spare ones; and the spare ones."""
        if j not in self.groups:
            top = self.starts[j + 1] - 1
            least = max(differing(a, self.percent) for a in range(max(self.starts[j], top - 40), top + 1)) + 1
            empty = lambda spare: (least + spare) * math.exp(-self.starts[j] / (least + spare))
            spare = next((x for x in range(SPARE, least) if x >= empty(x) + 4 * math.sqrt(empty(x))), least)
            self.groups[j] = least + spare, spare
        return self.groups[j]

    def parts(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(need, keys) of a sorted set: linked sets that differ share at least need keys of some part, by the need of either."""
        n = len(s)
        out: list[tuple[int, np.ndarray]] = []
        with np.errstate(over="ignore"):
            if n and -(-self.percent * n // 100) < self.boundary:
                # overlaps with a partner below the boundary, or with any partner if this set is
                a_from, a_to = -(-self.percent * n // 100), most_partner(n, self.percent) if n < self.boundary else self.boundary - 1
                sizes = sorted({least_overlap(min(a, n), max(a, n), self.percent) for a in range(max(a_from, 1), a_to + 1)})
                m = _mix(s)
                for size in sizes:
                    if size > n:
                        continue
                    total = m.sum(dtype=np.uint64)
                    gone = np.array([m[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), n - size)], np.uint64)
                    out.append((1, np.unique(_mix((total - gone) ^ _C[3]) + np.uint64(size))))
            if n >= self.boundary:
                for start, groups, spare in self.classes(n):
                    g = (_mix(s ^ _C[1]) % np.uint64(groups)).astype(np.int64)
                    held = np.bincount(g, minlength=groups)
                    order = np.argsort(g, kind="stable")
                    sums = np.zeros(groups, np.uint64)
                    full = np.flatnonzero(held)
                    at = np.concatenate([[0], np.cumsum(held[full])[:-1]])
                    sums[full] = np.add.reduceat(_mix(s ^ _C[2])[order], at)
                    # beyond spare empty groups, a set also enters the lists of empty groups
                    few = groups - len(full) <= spare
                    use = full if few else np.arange(groups)
                    # equal empty groups aren't entered by both, unless both have many
                    need = 1 + spare - (groups - len(full)) if few else 1
                    out.append((need, np.unique(_mix(sums[use] + use.astype(np.uint64) * _C[0] + np.uint64(start) * _C[3]))))
        return out

    def keys(self, s: np.ndarray) -> np.ndarray:
        """All keys of a sorted set."""
        return np.unique(np.concatenate([k for _, k in found])) if (found := self.parts(s)) else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _node(s: np.ndarray) -> int | None:
    if not len(s):
        return None
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _keyed(ngram: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch in batches:
            sizes, nodes, keys, counts, needs = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, ngram)
                parts = scheme.parts(s)
                sizes.append(len(s))
                nodes.append(_node(s))
                keys.append([_signed(k) for _, k in parts])
                counts.append([len(k) for _, k in parts])
                needs.append([n for n, _ in parts])
            ends = np.concatenate([[0], np.cumsum([sum(c) for c in counts])])
            flat = [k for own in keys for k in own]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
            columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists, pa.array(counts, pa.list_(pa.int32())), pa.array(needs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), *columns], ["doc_id", "text_id", "n_shingles", "node", "keys", "counts", "needs"])

    return run


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t, ngram) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("node"), batch.column("blocks"), pa.array([s.tobytes() for s in made], pa.binary())], ["grp", "node", "blocks", "shingles"])

    return run


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Indexes of the pairs of a and b that link: scans of the inverted lists of b."""
    if not a or not b:
        return
    sizes = np.array([len(x) for x in b])
    tokens = np.concatenate(b)
    owners = np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    for i, s in enumerate(a):
        lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        n = hi - lo
        hit = n > 0
        n, lo = n[hit], lo[hit]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(int(n.sum()))
        common = np.bincount(owners[at], minlength=len(b))
        for j in np.flatnonzero(100 * common >= percent * (len(s) + sizes - common)).tolist():
            if common[j]:
                yield i, j


def _compare(percent: int):
    """One block against another: a forest of the links between different nodes."""

    def run(table: pa.Table) -> pa.Table:
        d = table.to_pydict()
        sides: tuple[dict, dict] = ({}, {})
        for node, side, raw in zip(d["node"], d["side"], d["shingles"], strict=True):
            sides[side][node] = np.frombuffer(raw, np.uint64)
        left, right = sides[0] or sides[1], sides[1] or sides[0]
        names = sorted(left), sorted(right)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out: list[tuple[int, int]] = []
        for i, j in linked([left[x] for x in names[0]], [right[x] for x in names[1]], percent):
            x, y = names[0][i], names[1][j]
            if (p := root(x)) != (q := root(y)):
                parent[p] = q
                out.append((x, y))
        return pa.table({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})

    return run


def _shared(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries whose key another node has, too, with the key's least node."""
    lists = Window.partitionBy("key")
    cold = entries.join(F.broadcast(hot), "key", "left_anti").withColumn("least", F.min("node").over(lists)).withColumn("most", F.max("node").over(lists))
    often = entries.join(F.broadcast(hot), "key", "left_semi")
    ends = often.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    # as many rows as there are hot keys
    warm = often.join(F.broadcast(ends), "key")
    return cold.unionByName(warm).where("least <> most").drop("most")


def _met(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries whose key another node has, too, from one pass over them: a hot key's, known to be met, are dealt over SALTS tasks."""
    tagged = entries.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    salted = tagged.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0))
    lists = Window.partitionBy("key", "salt")
    both = salted.withColumn("least", F.min("node").over(lists)).withColumn("most", F.max("node").over(lists))
    return both.where(F.col("hot") | (F.col("least") != F.col("most"))).select(*entries.columns)


def in_passes(column: str, of: Callable[[Column], DataFrame], name: str, passes: int = PASSES) -> DataFrame:
    """of(a share of the values of a column) for each share, written one after the other: all rows, in tables of their own."""
    share = F.pmod(F.xxhash64(column, F.lit(13)), F.lit(passes))
    return reduce(DataFrame.unionByName, [materialize(of(share == p), name) for p in range(passes)])


def passes_for(size: int) -> int:
    """Passes over the keys of so many bytes of text."""
    return max(PASSES, -(-size // PASS_BYTES))


def _stars(nodes: DataFrame, passes: int = PASSES) -> DataFrame:
    """(node, least): the lists' members that can have a link, with their list's least one. nodes: node, keys, counts, needs."""
    part = F.expr("explode(filter(transform(counts, (n, i) -> struct(i as part, needs[i] as need, slice(keys, cast(aggregate(slice(counts, 1, i), 0, (a, b) -> a + b) as int) + 1, n) as keys)), p -> size(p.keys) > 0))")
    entries = nodes.select("node", part.alias("p")).select("node", "p.part", "p.need", F.explode("p.keys").alias("key"))
    sample = entries.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SAMPLE)) == 0)
    # at most (keys of a node) / HOT keys pass, however many nodes there are
    seen = max(SEEN, HOT * sample.select("node").distinct().count())
    hot = materialize(sample.groupBy("key").count().where(F.col("count") >= seen).select("key"), "hot-keys")
    enough = F.count("*").over(Window.partitionBy("node", "part")) >= F.col("need")
    # each pass keeps the entries that other nodes have, too: few of all
    met = in_passes("key", lambda own: _met(entries.where(own), hot), "met", passes)
    alive = met.withColumn("enough", enough).where("enough").drop("enough")
    return _shared(materialize(alive, "alive"), hot).select("node", "least").where("node <> least")


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_id", F.xxhash64("text"))
    passes = passes_for(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    made = own.mapInArrow(_keyed(ngram, percent), "doc_id bigint, text_id bigint, n_shingles bigint, node bigint, keys array<bigint>, counts array<int>, needs array<int>")
    full = materialize(made.withColumn("turn", F.pmod(F.xxhash64("node"), F.lit(passes)).cast("int")), "shingle-keys", by="turn")
    # from here on rows need no keys
    keyed = materialize(full.drop("keys", "counts", "needs", "turn"), "shingle-nodes")

    # one row a node; copies meet in the partial aggregate. Keys stand on disk once: those of a pass go when its nodes have them
    parts = []
    for turn in range(passes):
        sets_of = full.where((F.col("turn") == turn) & F.col("node").isNotNull())
        parts.append(materialize(sets_of.groupBy("node").agg(F.min(F.struct("keys", "counts", "needs")).alias("x")).select("node", "x.*"), "node-keys"))
        discard(full, part=f"turn={turn}")
    nodes = reduce(DataFrame.unionByName, parts)
    stars = _stars(nodes, passes)
    # a node of several least members is linked to the first of them only, and the others are linked to it: most nodes of a large group share these pairs
    met = stars.withColumn("first", F.min("least").over(Window.partitionBy("node")))
    pairs = met.select(F.when(F.col("least") == F.col("first"), F.col("node")).otherwise(F.col("least")).alias("node"), "first").distinct()
    candidates = connected_components(pairs, "node", "first")
    discard(nodes)
    forget(spark)

    # the candidates' sets, made again from their texts, so that no set is stored for documents without any partner
    sized = candidates.groupBy("component").agg(F.count("*").alias("size"))
    grouped = candidates.join(sized, "component").select("node", F.col("component").alias("grp"), F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    # a node's row is known by doc_id and text: a null doc_id has rows, too, and one doc_id can have several texts
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_id")).alias("rep")
    reps = keyed.where("node is not null").groupBy("node").agg(rep).join(grouped, "node").select(F.col("rep.doc_id").alias("own_id"), F.col("rep.text_id").alias("own_text"), "node", "grp", "blocks")
    texts = own.join(reps, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_id") == F.col("own_text")))
    sets = materialize(texts.mapInArrow(_sets(ngram), "grp bigint, node bigint, blocks int, shingles binary"), "shingle-sets")
    sets = sets.withColumn("at", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))

    forest = "src bigint, dst bigint"
    inside = sets.select("grp", "at", "node", F.lit(0).alias("side"), "shingles")
    links = materialize(inside.groupBy("grp", "at").applyInArrow(_compare(percent), forest), "links")

    # round 2: nodes outside the largest component of their group, against all blocks of the group
    first = connected_components(links)
    labelled = sets.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = labelled.where("blocks > 1").groupBy("grp", "component").agg(F.count("*").alias("n"))
    largest = heads.groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most")).where("most < all")
    rest = labelled.join(largest, "grp").withColumn("parts", F.ceil((F.col("all") - F.col("most")) / block).cast("int"))
    part = F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int")
    asking = rest.where("component <> largest").select("grp", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "node", F.lit(0).alias("side"), "shingles")
    asked = rest.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "at", "node", F.lit(1).alias("side"), "shingles")
    more = asking.unionByName(asked).groupBy("grp", "part", "at").applyInArrow(_compare(percent), forest)

    # rows that share a doc_id are one document: their sets are linked, too
    same = keyed.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("dst"), F.count_distinct("node").alias("n")).where("n > 1")
    others = keyed.join(same.select("doc_id", "src"), "doc_id").select("src", F.col("node").alias("dst")).where("dst is not null")
    every = materialize(links.unionByName(more).unionByName(others).where("src <> dst"), "links")
    discard(candidates, sets, links, first)
    forget(spark)

    component = connected_components(every)
    discard(every)
    reached = keyed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    named = reached.join(component, "node", "left")
    whole = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("component_id"))
    shared = named.where("n > 1 or component is not null").join(whole, "component", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return keyed.select("doc_id", "n_shingles", "node").join(shared, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, one row a doc_id; null doc_ids stay."""
    own = docs.columns
    kept = jaccard_components(docs, ngram, percent).where("component_id = doc_id").select(F.col("doc_id").alias("__id")).distinct()
    first = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__id")).dropDuplicates(["doc_id"]).select(*own)
    return first.unionByName(docs.where("doc_id is null"))
