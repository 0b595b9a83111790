"""Operators against brute force, exact round trips and edge cases, on small tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from strandlake.llm import byte_bpe, co_training, jaccard_join, language_id, license_scan, mixing, quality_rules, suffix_dedup, token_file, topk_search

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string"
WORDS = "the of and stone river light paper green table morning window garden seven little under quiet".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.5) for _ in range(n))


def table(spark, rows):
    """rows: (doc_id, text[, lang, source]); score and node clash with names that operators use."""
    full = [(r[0], r[1], *(r[2:] or ("en", "web")), len(r[1]) if r[1] else None, 0.5, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = prose(20_000, 1)
    rows = [(1, prose(80, 2)), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, prose(80, 2)), (7, prose(80, 2)), (None, prose(60, 3)), (8, "!!! ... 123"), (9, prose(70, 4), None, None), (10, "é ß 漢字 \U0001f600 word", "de", "web")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id bigint, quality int, toxic int"


def every(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], LABELS)
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    yield "co_training", co_training.quality_scores(docs, labels)
    yield "token_file", token_file.token_file(docs, word)
    yield "language_id", language_id.language_id(docs)
    yield "quality_rules", quality_rules.quality_rules(docs)
    yield "byte_bpe", byte_bpe.byte_bpe(docs, byte, public_tokenizers.PATTERN)
    yield "mixing", mixing.mix_digest(docs)
    yield "license_scan", license_scan.license_scan(docs)
    yield "jaccard", jaccard_join.jaccard_components(docs)


def test_odd_rows_each_get_a_result(spark, odd):
    for name, out in every(spark, odd):
        assert out.count() == odd.count(), name
    assert suffix_dedup.repeated_passages(odd).count() >= 4
    assert topk_search.top_k(odd, step=2).count() > 0


def test_empty_tables(spark, empty):
    for name, out in every(spark, empty):
        assert out.count() == 0, name
    assert suffix_dedup.repeated_passages(empty).count() == 0
    assert topk_search.top_k(empty).count() == 0


def test_quality_rules_base_counts(spark):
    text = "a b c a b c x\nline two\nline two\n\n# | > end"
    row = quality_rules.quality_rules(table(spark, [(1, text)])).first()
    assert (row.n_words, row.n_dup_lines, row.n_symbols) == (15, 1, 3)
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    assert row.n_repeat_words == len(covered) and row.base_failed and not row.kept


def test_quality_rules_reject_junk_and_keep_prose(spark):
    rows = [(i, prose(120, i)) for i in range(300)] + [(1000 + i, " ".join(w + "***" for w in prose(120, i).split())) for i in range(15)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert all(out[i] for i in range(300)) and not any(out[1000 + i] for i in range(15))


def test_accepted_keeps_columns(spark, odd):
    assert quality_rules.accepted(odd).columns == odd.columns


def test_token_file_against_library(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {11: "Don't STOP... it's 3.5, ok?", 12: "ΟΔΟΣ ΣΑΣ", 13: "İstanbul ﬁne café café", 14: "a,b.c ,, .. x", 15: "<|endoftext|> y", 18: "a <|EndOfText|>b, c. d.. e", 19: "x. ´, İ, \x1c, 1. é.", 16: None, 17: "漢字 kana tail z"}
    out = token_file.token_file(table(spark, list(texts.items())), public_tokenizers.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    start = 0
    for r in out:
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), r.doc_id
        start += len(ids)


def test_token_file_reads_metadata_alone(spark, odd, tmp_path):
    token_file.write_tokens(odd, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    meta = token_file.read_tokens(spark, str(tmp_path / "t"), ("doc_id", "n_tokens"))
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString()
    assert meta.count() == odd.count()


def test_byte_bpe_against_library(spark, odd):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(20, "Hello  world\n\n  it's 2024!"), (21, "é漢字\U0001f600 zzzzqqqq " + "ab" * 300), (22, " " * 700 + "x"), (23, None), (24, "<|endoftext|>")]
    docs = table(spark, rows)
    want = {i: own.encode_ordinary(t or "") for i, t in rows}
    for r in byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    for r in byte_bpe.encode_native(docs.where("doc_id <> 22"), ranks, public_tokenizers.PATTERN).collect():
        assert r.ids == " ".join(map(str, want[r.doc_id])) and bytes(r.decoded) == (dict(rows)[r.doc_id] or "").encode()


def test_fold_of_every_token_is_itself():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for token, rank in list(ranks.items())[::97]:
        parts = byte_bpe._fold_long(token, ranks)
        assert parts == [rank]


def test_mixing_near_targets(spark):
    r = random.Random(5)
    rows = [(i, prose(r.randrange(5, 200), i), "en", r.choice(["a", "b", "c", "tiny"][: 4 if i % 40 == 0 else 3] + [None] * (i % 9 == 0))) for i in range(400)]
    out = mixing.mix_digest(table(spark, rows)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {x[0]: x[3] for x in rows}
    for x in out:
        sizes[source[x.doc_id]] += x.size
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
        assert 0 <= x.taken <= 3 * x.size
    total = sum(sizes.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for s in sizes:
        assert target[s] <= 3 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= 16, s
    assert out == mixing.mix_digest(table(spark, rows)).collect() or sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix_digest(table(spark, rows)).collect()))


def test_quotas_are_sainte_lague(spark):
    rows = [("a", 500.0), ("b", 300.0), ("c", 170.0), ("d", 30.0)]
    s = spark.createDataFrame([(i + 1, t, 1000) for i, (_, t) in enumerate(rows)], "rank bigint, target double, total bigint")
    got = defaultdict(int)
    for x in mixing.quotas(s, 10, 4).collect():
        assert x.blocks >= 0
        got[x.rank] += x.blocks
    seats = [0] * 4
    for _ in range(100):
        j = max(range(4), key=lambda j: (rows[j][1] / (2 * seats[j] + 1), -j))
        seats[j] += 1
    assert [got[i + 1] for i in range(4)] == seats


def test_license_scan(spark):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "CC BY, cc-by cc by"), (3, "the mit\nlicense GNU General Public License"), (4, "mitlicense apache"), (5, None), (6, "All Rights Reserved copyright")]
    out = {r.doc_id: r for r in license_scan.license_scan(table(spark, rows)).collect()}
    assert (out[1].base_labels, out[1].labels, out[1].first_word, out[1].n_base) == ("apache", "apache,apache-2.0", 4, 1)
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].base_labels) == (3, 0, 4, "cc-by")
    assert out[3].base_labels == "gpl,mit" and out[3].first_word == 1 and out[3].last_word == 3
    assert (out[4].n_base, out[4].first_word, out[4].base_labels, out[4].score) == (0, None, "", 0.0)
    assert (out[5].n_words, out[5].labels) == (0, "") and out[6].labels == "reserved"


def test_license_scan_against_every_template(spark):
    import re

    r = random.Random(12)
    vocabulary = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()}) + WORDS
    rows = [(1000, None), (1001, ""), (1002, "x" * 50_000)]
    for i in range(150):
        lines = []
        for _ in range(r.randrange(1, 4)):
            words = list(r.choice(list(license_scan.TEMPLATES.values())).split())
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            lines.append(r.choice([" ", ", "]).join(w.upper() if r.random() < 0.1 else w for w in words) + r.choice(["", " ".join(r.choice(WORDS) for _ in range(5))]))
        rows.append((i, r.choice(["\n", "\n\n", " "]).join(lines)))
    found = {x.doc_id: x for x in license_scan.license_scan(table(spark, rows)).collect()}
    split = lambda t: [w for w in re.split(license_scan.SEPARATORS, t) if w]
    for i, text in rows:
        low = (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
        words, places = split(low), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
        own = set()
        for block in low.split("\n") + re.split(r"\n[ \t\r]*\n", low):
            b = set(split(block))
            own |= {label for label, t in license_scan.TEMPLATES.items() if len(b & set(t.split())) >= math.ceil(license_scan.THRESHOLD * len(set(t.split())) - 1e-9)}
        x, base = found[i], {label for _, label in places}
        assert (x.n_words, x.n_base, x.base_labels, x.labels) == (len(words), len(places), ",".join(sorted(base)), ",".join(sorted(base | own))), i
        assert (x.first_word, x.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_license_templates_of_a_table(spark):
    t = spark.createDataFrame([("a", "One, TWO; three four"), ("a", "zzz"), (None, "x"), ("b", None)], "label string, text string")
    assert license_scan.templates_of(t) == {"a": "one two three four"}
    with pytest.raises(ValueError):
        license_scan.templates_of(spark.createDataFrame([("a", "x" * (license_scan.MOST_BYTES + 1))], "label string, text string"))


def brute_em(votes, counts):
    """The same estimates in plain numpy, a vote pattern a row."""
    v, c = np.array(votes), np.array(counts, float)
    starts = [(quality_rules.ONE_FROM_GOOD, quality_rules.ONE_FROM_BAD) if n in quality_rules.ONE_SIDED else (quality_rules.FROM_GOOD, quality_rules.FROM_BAD) for n in quality_rules.RULES]
    good, bad, prior = [list(g) for g, _ in starts], [list(b) for _, b in starts], quality_rules.PRIOR
    w = quality_rules.WEIGHT

    def posterior():
        odds = np.full(len(v), math.log(prior / (1 - prior)))
        for j in range(len(starts)):
            odds += [math.log(good[j][x + 1] / bad[j][x + 1]) for x in v[:, j]]
        return 1 / (1 + np.exp(-odds))

    for _ in range(quality_rules.ROUNDS):
        q = posterior()
        prior = min(max((c @ q + w * quality_rules.PRIOR) / (c.sum() + w), 0.05), 0.95)
        for j, (g, b) in enumerate(starts):
            for k, x in enumerate(quality_rules.VOTES):
                at = v[:, j] == x
                good[j][k] = ((c * q)[at].sum() + w * g[k]) / (c @ q + w)
                bad[j][k] = ((c * (1 - q))[at].sum() + w * b[k]) / (c @ (1 - q) + w)
    return posterior()


def test_quality_rules_verdict_is_plain_em(spark):
    rows = [(i, prose(120, i)) for i in range(200)] + [(1000 + i, " ".join(w + "***" for w in prose(120, i).split())) for i in range(20)]
    rows += [(2000 + i, prose(55, i).upper()) for i in range(15)] + [(3000 + i, "a b c " * 40) for i in range(10)]
    judged = quality_rules.judge(table(spark, rows)).collect()
    patterns = Counter(tuple(x.votes) for x in judged)
    want = dict(zip(patterns, brute_em(list(patterns), list(patterns.values())), strict=True))
    for x in judged:
        assert abs(x.p_good - want[tuple(x.votes)]) < 1e-9 and x.kept == (not x.base_failed and x.p_good >= quality_rules.KEEP_FROM)
    p = quality_rules.estimate(quality_rules.judge(table(spark, rows)))
    for good, bad in quality_rules.chances(p).values():
        assert abs(sum(good) - 1) < 1e-9 and abs(sum(bad) - 1) < 1e-9


def test_one_noisy_rule_rejects_nothing(spark):
    # a rule that others don't bear out votes bad on three of ten clean rows
    good = [1, 0, 0, 0, 1, 1, 0, 0, 1]
    noisy = [1, 0, 0, 0, 1, 1, -1, 0, 1]
    junk = [1, -1, 0, -1, 1, -1, 0, 0, -1]
    voted = spark.createDataFrame([(v,) for v, n in ((good, 700), (noisy, 300), (junk, 80)) for _ in range(n)], "votes array<int>")
    p = quality_rules.estimate(voted)
    q = {tuple(x.votes): x.q for x in voted.distinct().select("votes", quality_rules._posterior(F.col("votes"), F.array(*[F.lit(x) for x in p])).alias("q")).collect()}
    assert q[tuple(good)] > 0.9 and q[tuple(noisy)] > 0.9 and q[tuple(junk)] < 0.1


def test_letters_alone_have_a_language(spark):
    kinds = {"xx": "ba be bi bo bu".split(), "yy": "kra kre kri kro kru".split()}
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice(v) for _ in range(3)) for _ in range(30)), lang, "web") for i in range(80) for lang, v in [sorted(kinds.items())[i % 2]]]
    odd = [(900, "\u00bd \u00b2 \u2460 \u2167"), (901, "_ 12 ٣"), (902, ""), (903, "\u00bd bababi"), (904, "漢字 漢字")]
    out = {x.doc_id: x for x in language_id.language_id(table(spark, rows + [(*o, None, "web") for o in odd])).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert out[903].lang_pred == "xx" and out[904].lang_pred in kinds and out[904].rejected and out[904].score <= 0.5


def test_a_language_of_long_texts_is_learnt(spark):
    r = random.Random(3)
    word = lambda v: "".join(r.choice(v) for _ in range(3))
    rows = [(i, " ".join(word("ba be bi".split()) for _ in range(30)), "xx", "web") for i in range(40)]
    rows += [(100 + i, " ".join(word("zo zu za".split()) for _ in range(40_000)), "zz", "web") for i in range(4)]
    out = language_id.language_id(table(spark, rows + [(500, "zozuza zazozu", None, "web")])).where("doc_id = 500").first()
    assert out.lang_pred == "zz"


def test_calibration_is_inside_its_range():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(1, 1, (300, 5)), r.normal(-1, 1, (300, 5))]).astype(np.float32)
    y = np.repeat([1, 0], 300)
    at = r.permutation(600)
    x, y = x[at], y[at]
    view = co_training.Logistic(x[:400], y[:400].astype(np.float32), np.ones(400, np.float32))
    view.calibrate(x[400:], y[400:])
    p = 1 / (1 + np.exp(-view.odds(x[400:])))
    assert 0 < view.a < 20 and abs(view.c) < 10 and abs(p.mean() - y[400:].mean()) < 0.03
    assert ((p - y[400:]) ** 2).mean() < 0.05


def test_repeated_ids_are_fitted_on_once(spark):
    rows = [(i % 60, prose(60, i) if i % 2 else "|".join(prose(60, i).upper().split()), "en", "web") for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] * 2, LABELS)
    docs = table(spark, rows).select("doc_id", "text", "source", "lang", "n_chars")
    a, b = co_training.fit(docs, labels), co_training.fit(docs.repartition(5), labels)
    assert np.allclose(a.text.w, b.text.w) and a.base == b.base


def test_pipeline_stages_on_planted_rows(spark, tmp_path):
    import corpus_pipeline

    passage = prose(70, 1)
    rows = [(1, prose(90, 2)), (2, prose(90, 2)), (3, prose(60, 3) + " " + passage), (4, prose(60, 4) + " " + passage), (5, "short"), (6, None)]
    rows += [(100 + i, prose(100, 50 + i)) for i in range(60)] + [(300 + i, " ".join(w + "###" for w in prose(100, 150 + i).split())) for i in range(8)]
    table(spark, [(*x, "en", f"s{x[0] % 3}") for x in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        kept.append({x.doc_id: x.text for x in out.collect()})
        docs = out
    quality, near, passages, mixed = kept
    assert {5, 6}.isdisjoint(quality) and not any(i >= 300 for i in quality) and {1, 2, 3, 4, *range(100, 160)} <= set(quality)
    assert 1 in near and 2 not in near and set(quality) - set(near) == {2}
    assert passages[3].count(passage) == 1 and passage not in passages[4] and passages[4].split() == prose(60, 4).split()
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in final} <= set(mixed)
    for x in final:
        assert x.n_tokens == len([t for w in regex.findall(public_tokenizers.PATTERN, passages[x.doc_id]) for t in byte_bpe.fold(w.encode(), ranks)])
        assert x.decoded_sha256 == hashlib.sha256(passages[x.doc_id].encode()).hexdigest()


def brute_components(rows, k, percent):
    sets = {i: set(jaccard_join.shingles(t, k).tolist()) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components_against_brute_force(spark, k, percent):
    r = random.Random(k)
    rows = []
    for g in range(40):
        words = prose(r.randrange(5, 160), 1000 + g).split()
        for _ in range(8):
            own = list(words)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                at = r.randrange(len(own))
                own[at : at + r.choice([0, 1])] = [f"w{r.randrange(10**6)}"]
            rows.append((len(rows), " ".join(own)))
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(table(spark, rows), k, percent, block=5).collect()}
    assert got == brute_components(rows, k, percent)


def test_jaccard_keys_meet_for_every_linked_pair():
    r = random.Random(9)
    scheme = jaccard_join.Scheme(90)
    for n in [*range(9, 60), 100, 333, 1000]:
        for _ in range(4):
            a = np.unique(np.array([r.getrandbits(63) for _ in range(n)], np.uint64))
            for cut in range(0, n // 9 + 1):
                for add in range(0, n // 9 + 1 - cut):
                    if 100 * (n - cut) >= 90 * (n + add) and cut + add:
                        b = np.unique(np.concatenate([a[cut:], np.array([r.getrandbits(63) for _ in range(add)], np.uint64)]))
                        assert len(np.intersect1d(scheme.keys(a), scheme.keys(b))), (n, cut, add)


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_linked_sets_share_the_keys_they_need(percent):
    r = random.Random(percent)
    scheme = jaccard_join.Scheme(percent)
    some = lambda n: [r.getrandbits(63) for _ in range(n)]
    for n in [*range(2, 60), 75, 130, 333, 800]:
        for _ in range(8):
            a = some(n)
            gone = r.randrange(0, n * (100 - percent) // 100 + 1)
            new = (100 * (n - gone) - percent * n) // percent
            b = a[gone:] + some(r.randrange(0, new + 1))
            x, y = (np.unique(np.array(z, np.uint64)) for z in (a, b))
            common = len(np.intersect1d(x, y))
            if len(x) == len(y) == common or 100 * common < percent * (len(x) + len(y) - common):
                continue
            for one, other in ((x, y), (y, x)):
                held = scheme.keys(other)
                assert any(len(np.intersect1d(k, held)) >= need for need, k in scheme.parts(one)), (n, gone)


def test_jaccard_hot_keys_give_the_same(spark, monkeypatch):
    rows = [(i, " ".join([prose(60, 1), prose(6, 10 + i // 3)])) for i in range(150)] + [(500 + i, prose(70, 900 + i)) for i in range(40)]
    monkeypatch.setattr(jaccard_join, "SEEN", 1)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(table(spark, rows), 3, 90, block=20).collect()}
    assert got == brute_components(rows, 3, 90)


def test_jaccard_keys_of_long_sets_at_80():
    r = random.Random(8)
    scheme = jaccard_join.Scheme(80)
    some = lambda n: np.unique(np.array([r.getrandbits(63) for _ in range(n)], np.uint64))
    # unrelated long sets have no list in common, linked ones have
    keys = [scheme.keys(some(n)) for n in [100, 250, 400, 900] * 12]
    assert len(np.unique(np.concatenate(keys))) == sum(map(len, keys))
    for n in (15, 40, 100, 250, 400, 900):
        for _ in range(6):
            a = some(n)
            for cut, add in ((0, n // 4), (n // 5, 0), (n // 9, n // 9)):
                b = np.union1d(np.array(r.sample(a.tolist(), n - cut), np.uint64), some(add))
                assert len(np.intersect1d(scheme.keys(a), scheme.keys(b))), (n, cut, add)


def test_pipeline_links_near_copies_at_80(spark):
    import corpus_pipeline

    words = prose(100, 4).split()
    changed = [f"new{j}" if j in (30, 60) else w for j, w in enumerate(words)]
    a, b = (set(jaccard_join.shingles(" ".join(x), 5).tolist()) for x in (words, changed))
    assert 0.8 <= len(a & b) / len(a | b) < 0.9
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, prose(100, 5))]
    assert sorted(x.doc_id for x in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()) == [1, 3]


def test_jaccard_links_of_null_ids_and_of_two_texts_under_one_id(spark):
    a, x, y = ([f"{c}{j}" for j in range(300)] for c in "axy")
    # 1 and 2 link through a row without an id only
    rows = [(1, " ".join(a[:200])), (None, " ".join(a[:215])), (2, " ".join(a[:230]))]
    rows += [(7, " ".join(x[:200])), (7, " ".join(y[:200])), (8, " ".join(x[:210])), (9, " ".join(y[:210]))]
    got = jaccard_join.jaccard_components(table(spark, rows)).collect()
    assert sorted((z.doc_id or 0, z.component_id) for z in got) == [(0, 1), (1, 1), (2, 1), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_one_of_each(spark, odd):
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id in (1, 5, 6, 7)").collect()) == [1, 5]


def test_suffix_spans_against_all_windows(spark):
    r = random.Random(3)
    passages = [prose(r.randrange(51, 90), 500 + i).split() for i in range(12)]
    rows = []
    for i in range(120):
        words = prose(r.randrange(20, 120), 2000 + i).split()
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(len(words))
            words[at:at] = r.choice(passages)
        rows.append((i, " ".join(words)))
    seen = defaultdict(list)
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].append((i, p))
    want = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                want[i].update(range(p, p + 50))
    got = {x.doc_id: {y for s in x.spans for y in range(s["start"], s["end"])} for x in suffix_dedup.repeated_passages(table(spark, rows)).collect()}
    # what the operator promises: nothing but repeated words, in every text that has some; words that only
    # chance adds to the ends of a passage, with a copy that sorts far off, can be missed
    assert all(v <= want[i] for i, v in got.items()) and {i for i, v in got.items() if v} == set(want)
    assert sum(len(v - got[i]) for i, v in want.items()) <= 0.01 * sum(map(len, want.values()))


def test_without_repeats_keeps_one_copy(spark):
    passage = prose(70, 1)
    rows = [(1, "one " + passage + " end"), (2, "two\n" + passage + "\nmore"), (3, prose(80, 9)), (4, prose(80, 9)), (5, None)]
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(table(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[2].text.split() == ["two", "more"] and out[3].text == rows[2][1]
    assert 4 not in out and out[5].text is None and out[2].n_chars == len(out[2].text)


def test_suffix_copies_of_rows_without_an_id(spark):
    a, b, c = prose(60, 71), prose(64, 72), prose(66, 73)
    docs = table(spark, [(None, a), (7, a), (None, b), (None, b), (3, c), (4, "x"), (None, "y"), (None, "y")])
    got = sorted((x.doc_id or 0, x.n_words, x.dropped_words) for x in suffix_dedup.repeated_passages(docs).collect())
    assert got == [(0, 60, 0), (0, 64, 0), (0, 64, 64), (7, 60, 60)]
    left = sorted((x.doc_id or 0, x.text) for x in suffix_dedup.without_repeats(docs).collect())
    assert left == sorted([(0, a), (0, b), (3, c), (4, "x"), (0, "y"), (0, "y")])


def test_suffix_drops_of_two_texts_under_one_id(spark):
    passage = prose(60, 81).split()
    one, other = prose(30, 82).split(), prose(30, 83).split()
    # the same number of words, the passage at different places
    rows = [(1, " ".join(passage)), (4, " ".join(one + passage)), (4, " ".join(passage + other)), (-9, " ".join(prose(20, 84).split() + passage))]
    left = sorted((x.doc_id, x.text) for x in suffix_dedup.without_repeats(table(spark, rows)).collect())
    assert [(i, t.split()) for i, t in left] == sorted([(-9, rows[3][1].split()), (4, one), (4, other)])


def test_suffix_drops_of_many_copies_against_all_windows(spark):
    r = random.Random(6)
    long, short = prose(70, 31).split(), prose(50, 32).split()
    rows = []
    for i in r.sample(range(10_000), 500):
        words = prose(r.randrange(4, 40), 40_000 + i).split()
        at = r.randrange(len(words))
        # whole passages, passages cut at either end, and passages that go on alike in some documents only
        a, b = r.choice([(0, 70), (0, 70), (r.randrange(20), 70), (0, 70 - r.randrange(20))])
        words[at:at] = [*long[a:b], *prose(r.randrange(0, 30), 90 + i % 7).split()]
        if i % 3 == 0:
            words += [*prose(5, 50_000 + i).split(), *short]
        rows.append((i, " ".join(words)))
    seen = defaultdict(list)
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].append((i, p))
    spans, drops = defaultdict(set), defaultdict(set)
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            spans[i].update(range(p, p + 50))
            drops[i].update(range(p, p + 50) if (i, p) > min(places) else ())
    got = {x.doc_id: x for x in suffix_dedup.repeated_passages(table(spark, rows)).collect()}
    cover = lambda found: {y for s in found for y in range(s["start"], s["end"])}
    for i, _ in rows:
        assert cover(got[i].spans if i in got else ()) == spans[i], i
        assert cover(got[i].drops if i in got else ()) == drops[i], i
    left = [x.text for x in suffix_dedup.without_repeats(table(spark, rows)).collect()]
    assert sum(" ".join(long) in t for t in left) == 1 and sum(" ".join(short) in t for t in left) == 1


def test_language_id_on_held_out_texts(spark):
    kinds = {"xx": "ba be bi bo bu".split(), "yy": "kra kre kri kro kru".split()}
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice(v) for _ in range(3)) for _ in range(30)), lang, "web") for i in range(200) for lang, v in [sorted(kinds.items())[i % 2]]]
    out = language_id.language_id(table(spark, [*rows, (900, "123 ...", "xx", "web"), (901, None, "xx", "web")])).collect()
    truth = {x[0]: x[2] for x in rows}
    for x in out:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        assert x.lang_pred == truth.get(x.doc_id, "und")


def test_kneser_ney_sums_to_one():
    model = language_id.Model(Counter({"abab": 3, "abba": 2, "b": 1}), order=3)
    letters = [ord(c) for c in "ab "]
    codes = np.array([[ord("a"), ord("b"), c] for c in letters], np.uint64)
    p = 2.0 ** -model.entropies(codes, np.full(len(letters), 3))
    assert 0.95 < p.sum() <= 1.0 + 1e-9


def test_co_training_finds_junk(spark):
    good = [(i, prose(100, i), "en", "web") for i in range(120)]
    bad = [(500 + i, " | ".join(prose(60, i).upper().split()), "en", "dump") for i in range(60)]
    labels = spark.createDataFrame([(x[0], int(x[0] < 500), 0) for x in good[:60] + bad[:30]], LABELS)
    out = {r.doc_id: r for r in co_training.quality_scores(table(spark, good + bad), labels).collect()}
    assert all(out[x[0]].kept for x in good) and not any(out[x[0]].kept for x in bad)
    assert all(0 <= out[i].score <= 1 for i in out)


def test_top_k_against_all_scores(spark):
    rows = [(i, prose(random.Random(i).randrange(1, 90), i % 70)) for i in range(300)]
    terms = {i: Counter(topk_search.terms_of(t).tolist()) for i, t in rows}
    length = {i: sum(c.values()) for i, c in terms.items()}
    mean, df = sum(length.values()) / len(rows), Counter(t for c in terms.values() for t in c)
    got = defaultdict(list)
    for x in topk_search.top_k(table(spark, rows), k=7).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.doc_id, round(x.score, 6)))
    for q in range(0, 300, 50):
        scores = []
        for i, c in terms.items():
            s = sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for t in terms[q].keys() & c.keys())
            if s > 0:
                scores.append((-round(s, 9), i))
        assert got[q] == [(i, round(-s, 6)) for s, i in sorted(scores)[:7]]


def test_top_k_over_shards_with_copies_and_rows_without_an_id(spark, monkeypatch):
    # several shards and tasks, blocks and clusters; copies tie, and a null id comes last among them
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 30_000)
    base = [(i, prose(random.Random(i).randrange(20, 90), i % 190)) for i in range(600)]
    rows = base + [(None, base[50][1]), (None, base[50][1]), (1000, base[50][1]), (-3, base[100][1])]
    terms = [Counter(topk_search.terms_of(t).tolist()) for _, t in rows]
    length = [sum(c.values()) for c in terms]
    mean, df = sum(length) / len(rows), Counter(t for c in terms for t in c)
    got = defaultdict(list)
    for x in topk_search.top_k(table(spark, rows), k=7).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.doc_id, round(x.score, 6)))
    for q in [i for i in range(0, 600, 50)] + [1000]:
        own = set().union(*[c for (i, _), c in zip(rows, terms, strict=True) if i == q])
        scores = []
        for (i, _), c, n in zip(rows, terms, length, strict=True):
            s = math.fsum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in own & c.keys())
            if s > 0:
                scores.append((-round(s, 9), i is None, i or 0, i))
        assert got[q] == [(i, round(-s, 6)) for s, _, _, i in sorted(scores)[:7]], q


def test_ranks_file_is_read():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert len(ranks) > 50_000 and base64.b64encode(b"!") and ranks[b"!"] == 0


def test_language_ngrams_are_looked_up_once(monkeypatch):
    looked = []
    plain = language_id.Model.entropies
    monkeypatch.setattr(language_id.Model, "entropies", lambda self, codes, depth: (looked.append(len(codes)), plain(self, codes, depth))[1])
    own = language_id.train([("en", "the running of the singing and the bringing")])
    words = [f"{a}{b}inging" for a in "bcdfgklmprst" for b in "aeiou"]
    sums = own.sums([" ".join(words)])[0]
    # a row a character would be 9 for each of the 60 words
    assert looked[-1] < 60 * 9 / 2 and sums[0] == 60 * 9
    alone = sum(language_id.train([("en", "the running of the singing and the bringing")]).sums([w])[0][1] for w in words)
    assert abs(sums[1] - alone) < 1e-6


def test_language_words_without_numerals():
    assert language_id.words_of("Ab½cd ²x ⅷ Straße 9_z 一") == ["ab", "cd", "x", "straße", "z", "一"]
    assert language_id.words_of(None) == [] == language_id.words_of("½ ²")


def test_search_build_frees_what_it_is_done_with():
    import tracemalloc

    import pyarrow as pa

    texts = [prose(400, s) for s in range(1500)]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "shard": pa.array([0] * len(texts), pa.int64())})
    topk_search.build(rows.slice(0, 10))
    tracemalloc.start()
    made = topk_search.build(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.num_rows == 1 and peak < 36 * 400 * len(texts), peak / (400 * len(texts))


def test_jaccard_keys_go_in_passes(spark, monkeypatch):
    written = []
    plain = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name, **kw: (written.append(name), plain(df, name, **kw))[1])
    own = [prose(60, s) for s in range(40)]
    rows = [(i, t) for i, t in enumerate(own)] + [(100 + i, t + " extra") for i, t in enumerate(own[:20])] + [(200, own[0]), (None, own[1])]
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table(spark, rows)).collect() if r.doc_id is not None}
    assert found == {i: i for i in range(40)} | {100 + i: i for i in range(20)} | {200: 0}
    # no single shuffle holds all keys
    assert written.count("node-keys") == written.count("met") == jaccard_join.PASSES > 1


def test_keys_of_the_jaccard_join_stand_on_disk_once(spark, monkeypatch):
    """The rows of a pass leave the first table when its nodes have their keys, and passes grow with the texts."""
    import os
    import random

    from strandlake.llm import jaccard_join

    held = []
    real = jaccard_join.materialize

    def counted(df, name, **options):
        out = real(df, name, **options)
        if name == "shingle-keys":
            held.append(out)
        if name == "node-keys":
            held.append(sum(os.path.exists(f.removeprefix("file://")) for f in held[0].inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    monkeypatch.setattr(jaccard_join, "PASS_BYTES", 4_000)
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[3]), (901, texts[4] + " xx"), (902, None), (None, texts[5])]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80)
    got = {x.doc_id: x.component_id for x in found.collect() if x.doc_id is not None}
    assert len(got) == 153 and got[900] == 3 and got[901] == 4 and got[902] == 902 and all(got[i] == i for i in range(150))
    left = held[1:]
    assert len(left) == jaccard_join.passes_for(sum(len(t or "") for _, t in rows)) > jaccard_join.PASSES
    # before, all of them stood until the last pass had ended
    assert left[0] > left[len(left) // 2] > left[-1] > 0
    monkeypatch.undo()
    assert jaccard_join.passes_for(0) == jaccard_join.passes_for(500_000_000) == 4 and jaccard_join.passes_for(6_000_000_000) == 15
