"""Components of links, of few and of many, against a plain search."""

import random

import pytest

from hushlake.llm import components as c


def plain(edges):
    beside = {}
    for a, b in edges:
        if a != b:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    roots = {}
    for start in sorted(beside):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in roots:
                roots[x] = start
                todo += beside[x]
    return roots


def cases():
    rng = random.Random(8)
    big = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)]
    return {
        "none": [],
        "loops": [(5, 5), (7, 7), (7, 8)],
        "chain": [(i + 1, i) for i in range(60)],
        "star": [(-9, i) for i in range(40)] + [(i, -9) for i in range(40)],
        "mixed": [(rng.choice(big), rng.choice(big)) for _ in range(45)] + [(-(1 << 63), (1 << 63) - 1)],
    }


@pytest.mark.parametrize("most", [1 << 18, 0])
@pytest.mark.parametrize("name", cases())
def test_components_equal_a_plain_search(spark, monkeypatch, name, most):
    monkeypatch.setattr(c, "IN_ONE_TASK", most, raising=False)
    edges = cases()[name]
    got = [tuple(r) for r in c.components(spark.createDataFrame(edges, "a long, b long")).select("node", "root").collect()]
    assert len(got) == len(set(got))
    assert dict(got) == plain(edges)


def test_few_links_take_one_table(spark, monkeypatch):
    # the rounds of stars, a dozen shuffles each, went to the driver's memory
    tables = []
    write = c.written
    monkeypatch.setattr(c, "written", lambda df, tag, *more: tables.append(tag) or write(df, tag, *more))
    c.components(spark.createDataFrame(cases()["chain"], "a long, b long")).collect()
    assert len(tables) == 1
