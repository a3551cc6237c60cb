"""The pipeline's stages against plain Python, each on its predecessor's rows."""

import re

import corpus_pipeline as c
import oracles as o
import pytest

from hushlake.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in c.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), name))
    return seen


def test_names():
    assert [n for n, _ in c.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "tokens"]


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_quality(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    failed = {r.doc_id for r in stages[0].collect() if o.quality(r.text)["base_failed"]}
    assert kept and not kept & failed


def test_near_duplicates(stages):
    """Groups by both rules, over all pairs: fingerprints within two bits, and 80 % of
    the 5-word shingles."""
    rows = stages[1].collect()
    ids = [r.doc_id for r in rows]
    least = dict(zip(ids, o.components(ids, [o.fingerprint(r.text) for r in rows])))
    sets = {}
    for r in rows:
        w = o.WORD.findall(r.text.lower())
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(i, j):
        up[max(root(i), root(j))] = min(root(i), root(j))

    for i in ids:
        join(i, least[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                join(i, j)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({root(i) for i in ids})


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not o.pii(r.text)
        text, found = before[r.doc_id], o.pii(before[r.doc_id])
        if not found and not re.search("[0-9]{2}", text):
            assert r.text == text
    assert any("<EMAIL>" in r.text for r in stages[3].collect())


def test_mixing(stages):
    assert {r.doc_id for r in stages[4].collect()} <= {r.doc_id for r in stages[3].collect()}


def test_tokens(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert r.decoded_sha256 == o.sha(texts[r.doc_id])
        assert r.ids_sha256 == o.sha(bytes(r.ids)) and len(r.ids) == 4 * r.n_tokens
