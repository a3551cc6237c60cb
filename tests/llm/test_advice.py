"""Cases that an earlier version left out."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from hushlake.llm import pii_spans, quality_rules, secret_scan
from hushlake.llm.common import written


@pytest.fixture(scope="module")
def references(spark, sf):
    return quality_rules.references(spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang"))


def test_a_wrong_language_is_rejected(spark, sf, references):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    right = quality_rules.judge(docs, references).where("quality.kept and quality.word_distance is not null").select("doc_id", "text", "lang")
    right = written(right, "right")
    assert right.count() >= 0.7 * docs.count()
    n = ["en", "de", "fr", "es"]
    for k in range(1, 4):
        wrong = F.element_at(F.array(*map(F.lit, n)), (F.array_position(F.array(*map(F.lit, n)), F.col("lang")) + k - 1).cast("int") % 4 + 1)
        kept = quality_rules.judge(right.withColumn("lang", wrong), references).where("quality.kept").count()
        assert kept <= 0.05 * right.count()
    # no declared language, no wrong one
    unknown = quality_rules.judge(right.withColumn("lang", F.lit(None).cast("string")), references)
    assert unknown.where("quality.kept").count() >= 0.95 * right.count()


@pytest.mark.parametrize("sent", [4096, 3])
def test_every_language_has_a_reference(spark, monkeypatch, sent):
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", sent, raising=False)
    latin = " ".join(f"word{k % 7}{'abcdefghijk'[k % 11]} The{k % 5}" for k in range(200))
    rows = [(f"l{k:02d}", latin) for k in range(70) for _ in range(2)]
    rows += [("zz", " ".join(chr(0x4E00 + 7 * k) * 3 for k in range(120)))] + [(None, latin)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    refs = quality_rules.references(docs)
    assert refs.count() == 72
    got = quality_rules.judge(docs, refs).select("lang", "quality.class_distance").collect()
    assert len(got) == len(rows)
    assert [r.class_distance for r in got if r.lang == "zz"] == [pytest.approx(0, abs=1e-6)]


def test_references_count_all_words_and_write_no_vocabulary(spark, monkeypatch):
    rng = random.Random(7)

    def text():
        return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))

    rows = [(rng.choice(["en", "de", "", None]), text()) for _ in range(300)]
    rows += [("none", None), ("none", " \n "), ("one", "w1"), (None, None)]
    tables = []
    monkeypatch.setattr(quality_rules, "written", lambda df, *a: tables.append(written(df, *a)) or tables[-1])
    refs = quality_rules.references(spark.createDataFrame(rows, "lang string, text string"))
    expected = {}
    for lang in {x for x, _ in rows}:
        own = Counter(w for x, t in rows if lang in (None, x) for w in (t or "").split())
        top = sorted(own.values(), reverse=True)[: quality_rules.TOP_WORDS]
        top += [0] * (quality_rules.TOP_WORDS - len(top))
        expected[lang] = [n / max(1, own.total()) for n in [*top, own.total() - sum(top)]]
    got = {r.lang: r.word_share for r in refs.collect()}
    assert got.keys() == expected.keys()
    for lang, share in expected.items():
        assert got[lang] == pytest.approx(share)
    # a row for each language, never one for each of their words
    assert all(t.count() <= len(expected) for t in tables)


def test_near_copies_go(spark):
    rng = random.Random(4)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def changed(text, k):
        out = list(text)
        for at in range(k):
            out[at * (len(out) // k) + 7] = f"x{rng.randrange(10**6)}"
        return out

    def alike(a, b):
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b) >= 0.8

    license_ = words(40)
    texts = []
    for _ in range(12):
        one = words(200) + license_
        texts += [one, changed(one, 2), changed(one, 3), changed(one, 4), changed(one, 9), list(one)]
    up = list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, "a b"), (901, "A  b"), (902, None), (903, "")], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted({root(i) for i in range(len(texts))} | {900, 902})
    assert 12 < len(got) < 50


def test_card_numbers_in_longer_runs(spark):
    texts = [
        "the numbers 7536784127813050 4845168114407329 here",
        "so 4111 1111 1111 1111 4012 8888 8888 1881 and",
        "see 7536784127813050 1234567812345678 there",
        "see 1234567812345678 1234567812345679 there",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[s.kind + ":" + texts[r.doc_id][s.start : s.end] for s in r.pii.spans] for r in pii_spans.with_spans(docs).orderBy("doc_id").collect()]
    assert got == [
        ["cardnumber:7536784127813050", "cardnumber:4845168114407329"],
        ["cardnumber:4111 1111 1111 1111", "cardnumber:4012 8888 8888 1881"],
        ["cardnumber:7536784127813050"],
        [],
    ]


def test_keys_of_letters_and_in_links(spark):
    texts = [
        "key qzjxkvbwpyhmfgtdlcnrsaoe end",
        "key QZJXKVBWPYHMFGTDLCNRSAOE end",
        "key qZJxkVBwpyHMfgTDlcNRsaOE end",
        "key qZJxkVBwpyHMf-gTDlcNRsaOEiU end",
        "see https://a.test/get?sig=x7Kq9ZpL2mW8vR4tY6nB1cD3",
        "see https://a.test/x7Kq9ZpL2mW8vR4tY6nB1cD3 and ordinary_words_joined_by_signs",
        "Donaudampfschifffahrtsgesellschaft internationalization getUserAccountInformationByIdentifier",
        "MAX_CONNECTION_TIMEOUT_SECONDS some-Words/Joined=byManySigns",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[texts[r.doc_id][s.start : s.end] for s in r.secrets.spans] for r in secret_scan.with_secrets(docs).orderBy("doc_id").collect()]
    assert got == [[t.split()[1]] for t in texts[:4]] + [["sig=x7Kq9ZpL2mW8vR4tY6nB1cD3"], [], [], []]
