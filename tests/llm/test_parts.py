"""Parts of the operators against plain versions."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hushlake.llm import boosted_trees, byte_bpe, pii_spans, quality_rules, secret_scan, simhash_neardup, source_mixing, token_counts, url_filter
from hushlake.llm.common import regex_spans, running_sums


def test_gray_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.arange(200, dtype=np.uint64), [simhash_neardup.ALL]]))
    codes = codes[np.argsort(simhash_neardup.gray_ranks(codes), kind="stable")]
    tree = simhash_neardup.GrayTree.of_codes(codes)
    found = {(int(i), int(j)) for q, leaf in tree.search(codes, 2) for i, j in zip(q, leaf)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert found == set(zip(*map(list, (x.tolist() for x in np.nonzero(near)))))


@pytest.mark.parametrize("parts", [1, 7])
def test_links_join_what_all_pairs_join(spark, monkeypatch, parts):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    codes = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(12)})
    monkeypatch.setattr(simhash_neardup, "CODES_PER_PARTITION", -(-len(codes) // parts))
    df = spark.createDataFrame([(simhash_neardup._signed(c),) for c in codes], "code long")
    edges = simhash_neardup.links(df)
    labels = {r.node: r.root for r in simhash_neardup.components(edges).collect()}
    up = {c: c for c in codes}

    def root(c):
        while up[c] != c:
            c = up[c]
        return c

    for a, b in itertools.combinations(codes, 2):
        if (a ^ b).bit_count() <= 2:
            up[root(a)] = root(b)
    expected, got = {}, {}
    for c in codes:
        expected.setdefault(root(c), set()).add(c)
        s = simhash_neardup._signed(c)
        got.setdefault(labels.get(s, s), set()).add(c)
    assert sorted(map(sorted, expected.values())) == sorted(map(sorted, got.values()))


def test_folded_merges_equal_heap_merges(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    docs = spark.createDataFrame([("the quick brown thndernt hehäéç 你好 12345 ---- a",), ("the the aaaaaaaa",)], "text string")
    rows = byte_bpe.dictionary(docs, public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN).collect()
    assert len(rows) > 10
    for r in rows:
        assert list(r.ids) == byte_bpe.merge_bytes(r.piece.encode(), ranks, shortcut=False)


def test_whole_tokens_are_proved():
    ranks, special = token_counts.read_tokenizer(public_tokenizers.path(token_counts.TOKENIZER))
    whole = token_counts.proved_whole(ranks)
    assert special == ["<|endoftext|>"] and len(whole) > 40_000
    assert all(byte_bpe.merge_bytes(w.encode(), ranks, shortcut=False).__len__() == 1 for w in list(whole)[:500])


def test_trees_run_as_expressions(spark):
    x, y = pii_spans.made_up(300, seed=9)
    trees = boosted_trees.BoostedTrees(rounds=5).fit(x, y)
    names = [f"f{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *names])
    got = df.select("i", trees.expression([F.col(n) for n in names]).alias("s")).orderBy("i").collect()
    assert np.allclose([r.s for r in got], trees.scores(x))


def test_candidates_held_out():
    trees, thresholds = pii_spans.model()
    x, y = pii_spans.made_up(2000, seed=77)
    bars = np.array([thresholds[k] for k in pii_spans.KINDS])[x[:, 0].astype(int)]
    chosen = trees.scores(x) >= bars
    assert (y[chosen] == 1).mean() >= 0.9 and chosen[y == 1].mean() >= 0.8


def test_features_are_the_same_in_spark(spark):
    cases = [("iban", "DE89 3704 0044 0532 0130 00", "IBAN: "), ("ssn", "123-45-6789", "order #"), ("natphone", "(555) 123-4567", "call $"), ("account", "12345678", "account "), ("birthdate", "01/02/1980", "born ")]
    df = spark.createDataFrame(cases, "kind string, value string, before string")
    for kind, value, before in cases:
        row = df.where(F.col("kind") == kind).select(F.struct("value", "before").alias("s"))
        got = row.select(F.array(*[c.cast("double") for c in pii_spans.feature_columns(kind, F.col("s"))])).first()[0]
        assert got == [float(v) for v in pii_spans.features(kind, value, before)]


def test_window_entropy(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef0123") for _ in range(n)) for n in (20, 21, 40, 75)] + ["a" * 30, "short"]

    def brute(t):
        best = 0.0
        for i in range(len(t) - 19):
            w = t[i : i + 20]
            best = max(best, -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w)))
        return best

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(secret_scan.window_entropy(F.col("t"))).collect()]
    assert np.allclose(got, [brute(t) for t in texts])


def test_divergence(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.3, 0.6]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    got = spark.range(1).select(quality_rules.divergence(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_poisson(spark):
    df = spark.range(20000).select(source_mixing.copies(1, F.col("id"), F.lit(1.7)).alias("a"), source_mixing.copies(2, F.col("id"), F.lit(150.0)).alias("b"))
    a, va, b, vb = df.agg(F.avg("a"), F.var_pop("a"), F.avg("b"), F.var_pop("b")).first()
    assert abs(a - 1.7) < 0.05 and abs(va - 1.7) < 0.1 and abs(b - 150) < 0.5 and abs(vb - 150) < 8


def test_mixture_meets_the_targets(spark):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "mid").alias("source"))
    got = {r.source: r["count"] for r in source_mixing.mix(docs, shares={"big": 0.2, "mid": 0.5, None: 0.3}).groupBy("source").count().collect()}
    for name, share in (("big", 0.2), ("mid", 0.5), (None, 0.3)):
        assert abs(got[name] / 30000 - share) < 0.02


def test_long_arrays(spark):
    n = 3000
    row = spark.range(1).select(running_sums(F.sequence(F.lit(1), F.lit(n))).alias("s"), regex_spans(F.repeat(F.lit("ab "), n), "b").alias("m")).first()
    assert list(row.s) == list(itertools.accumulate(range(1, n + 1)))
    assert [(m.start, m.end) for m in row.m] == [(3 * k + 1, 3 * k + 2) for k in range(n)]


def test_terms_have_boundaries():
    a = url_filter.automaton(("casino",), (("bet", 1), ("win", 2)))
    assert url_filter.count_terms("casino-x.org/bet/bet", a) == (1, 1, 1)
    assert url_filter.count_terms("casinos.org/bets/twin", a) == (0, 0, 0)
    assert url_filter.count_terms("win_bet", a) == (0, 2, 3)
