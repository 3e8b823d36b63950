import random

import pytest

from partloom.llm.components import components, linking_pairs

from ..conftest import rows


def plain(pairs):
    up = {}
    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return sorted((find(x), x) for x in list(up))


@pytest.mark.parametrize("task_links", [10, 60, 100_000])
def test_against_plain(spark, task_links):
    rnd = random.Random(task_links)
    pairs = {tuple(sorted(rnd.sample(range(300), 2))) for _ in range(220)} | {(i, i + 1) for i in range(1000, 1100)} | {(2000, 2000 + i) for i in range(1, 150)}
    named = [(f"K{a:05d}", f"K{b:05d}") for a, b in pairs]
    assert rows(components(spark.createDataFrame(named, "a string, b string"), task_links, 2)) == plain(named)


def test_which_pairs_link(spark):
    df = spark.createDataFrame(
        [("b", "A ", "high", 1, "x"), ("A", "B", "UNRESOLVED", 2, "x"), ("c", "d", " Unresolved", 1, "x"), ("D", "C", "human", 2, "x"), ("e", "e", "high", 1, "x"), ("f", None, "high", 1, "x"), (" ", "g", "high", 1, "x"), ("h", "i", None, 1, "x"), ("j", "k", "high", None, "x"), ("j", "k", "high", None, "x")],
        "p string, q string, band string, at int, a string",
    )
    assert rows(linking_pairs(df, "p", "q", "band", "at")) == [("C", "D"), ("J", "K")]
    assert components(linking_pairs(df.limit(0), "p", "q", "band", "at")).count() == 0
