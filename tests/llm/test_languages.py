"""op1 against plain Python: every column, for documents and pages, and odd rows."""

import collections
import math
import re

import pytest

from hushlake.llm import language_id as li

LEVEL2 = "co|com|org|net|ac|gov|gob|edu|or|ne|go|gv"


def plain(rows, languages, logs):
    """(language, posterior) of rows (text, declared, suffix, host, domain)."""
    n = len(languages) + 1
    cases = []
    for text, declared, suffix, host, domain in rows:
        names = [x for x in (declared, suffix) if x and x not in languages]
        other = names[0] if names else None

        def says(x, right):
            if not x:
                return [0.0] * n
            at = languages.index(x) if x in languages else n - 1 if x == other else None
            return [math.log(right if k == at else (1 - right) / max(1, n - 1)) for k in range(n)]

        local = [a + b for a, b in zip(li.likelihood(text, logs), says(declared, li.DECLARED))]
        if other is None and n > 1:
            local[-1] += li.NOTHING
        cases.append((local, says(suffix, li.SUFFIX), other, local.index(max(local)), host, domain))
    of_all = collections.Counter(c[3] for c in cases)
    of_domain = collections.Counter((c[5], c[3]) for c in cases)
    of_host = collections.Counter((c[5], c[4], c[3]) for c in cases)
    out = []
    for local, suffix, other, guess, host, domain in cases:
        p = [1 / n] * n
        for count, weight in (
            ([of_all[k] for k in range(n)], n),
            ([of_domain[domain, k] for k in range(n)], li.SMOOTHING),
            ([of_host[domain, host, k] for k in range(n)], li.SMOOTHING),
        ):
            count[guess] -= 1
            p = [(c + weight * q) / (sum(count) + weight) for c, q in zip(count, p)]
        score = [a + b + math.log(q) for a, b, q in zip(local, suffix, p)]
        best = score.index(max(score))
        out.append(((languages + [other or "und"])[best], 1 / sum(math.exp(x - score[best]) for x in score)))
    return out


def bare(html):
    unclosed = r"(?is)<script\b.*?(?:</script>|\Z)|<style\b.*?(?:</style>|\Z)|<!--.*?(?:-->|\Z)|</?[a-z!?][^>]*(?:>|\Z)"
    return re.sub("&[a-z]+;", " ", re.sub(unclosed, " ", html))


def page_case(url, html):
    url, html = url or "", html or ""
    m = re.match(r"[^/?#]*://([^/?#:]*)", url)
    host = m[1].lower() if m else ""
    tld = re.search("([a-z]+)$", host)
    declared = re.search(r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2})", html)
    domain = re.search(rf"((?:[^.]+\.(?:{LEVEL2})\.[a-z]{{2}}|[^.]+\.[^.]+))$", host)
    return (bare(html), declared[1].lower() if declared else "", li.SUFFIXES.get(tld[1], "") if tld else "", host, domain[1] if domain else "")


ODD_PAGES = [
    (1, "http://a.co.uk/x", '<html lang="en">The quick brown fox and the other one'),
    (2, "http://b.co.uk/x", "<html>Der schnelle Fuchs und die anderen <!-- never closed"),
    (3, None, None),
    (4, "no address", "<script>never closed " * 40),
    (5, "https://x.pl/", '<html lang="pl">brzmienie w trzcinie'),
    (5, "https://x.pl/", '<html lang="pl">brzmienie w trzcinie'),
    (None, "https://y.it:80/", "<p>a < b and c > d"),
]


@pytest.fixture(scope="module")
def model(spark, sf):
    return li.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def held(spark, model, rows, cases):
    got = li.fused(li.text_evidence(rows, model), model[0], ("key",)).collect()
    want = plain([cases[r] for r in sorted(cases)], *model)
    by_key = dict(zip(sorted(cases), want))
    assert len(got) == len(cases)
    for r in got:
        language, posterior = by_key[r.key]
        assert r.language == language
        assert r.posterior == pytest.approx(posterior, abs=2e-6)
        assert r.kept == (r.posterior >= li.MIN_POSTERIOR)


def test_pages(spark, sf, model):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + ODD_PAGES
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "key long, page_id long, url string, html string")
    rows = li.page_rows(df.withColumnRenamed("page_id", "was").withColumnRenamed("key", "page_id")).withColumnRenamed("page_id", "key")
    held(spark, model, rows, {k: page_case(u, h) for k, (_, u, h) in enumerate(pages)})


def test_documents(spark, sf, model):
    docs = [(r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(None, None), ("", "web"), ("ab", None)]
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, source string")
    rows = li.document_rows(df).withColumnRenamed("doc_id", "key")
    held(spark, model, rows, {k: (t or "", "", "", "source:" + (s or ""), "source:") for k, (t, s) in enumerate(docs)})


def test_held_out(spark, sf, model):
    """Documents of a larger table that the model has not seen."""
    docs = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    got = li.fused(li.text_evidence(li.document_rows(docs), model), model[0], ("doc_id",)).join(docs, "doc_id")
    assert got.where("language = lang").count() >= 0.97 * docs.count()


def test_many_languages_and_none(spark):
    rows = [(f"x{k:03d}", f"{chr(97 + k % 26)}{chr(97 + k // 26)}" * 20) for k in range(300)]
    languages, logs = li.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(languages) == li.TEXT_LANGUAGES and logs.shape == (len(languages) + 1, li.BINS)
    # one that is not fitted is found by what the page declares
    page = spark.createDataFrame([(1, "http://h.test/", '<html lang="zz">1234 5678')], "page_id long, url string, html string")
    got = li.fused(li.text_evidence(li.page_rows(page), (languages, logs)), languages, ("page_id",)).first()
    assert got.language == "zz"
    empty = li.fit(spark.createDataFrame([], "lang string, text string"))
    assert empty[0] == []
    got = li.fused(li.text_evidence(li.page_rows(page.limit(0)), empty), [], ("page_id",))
    assert got.count() == 0
    assert li.fused(li.text_evidence(li.page_rows(page), empty), [], ("page_id",)).first().language == "zz"
