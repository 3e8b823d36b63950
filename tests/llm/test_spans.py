import random

import pytest

from partloom.llm import spans

from ..conftest import rows


def brute(texts, n=200):
    """Positions of n characters that stand in another record too, by record."""
    seen = {}
    for d, t in texts:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(d)
    return {d: {i for i in range(len(t or "") - n + 1) if len(seen[t[i : i + n]]) > 1} for d, t in texts}


def test_cover_has_every_difference():
    assert {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER} == set(range(spans.PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdefgh ñ😀\n") for _ in range(n))
    shared = [word(k) for k in (200, 201, 199, 450, 260)]
    texts = [(i, word(rnd.randrange(300)) + rnd.choice([*shared, ""]) + word(rnd.randrange(200)) + rnd.choice([*shared, ""])) for i in range(60)]
    texts += [(100, shared[3][50:300]), (101, "x" * 900), (102, None), (103, ""), (104, word(250) * 2), (105, word(20_000) + shared[4]), (106, texts[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, at int").repartition(3)
    want = brute(texts)
    assert {r[0] for r in rows(spans.sharing_records(df))} == {d for d, s in want.items() if s}
    for r in spans.spans(df).collect():
        covered = {i + k for i in want[r["doc_id"]] for k in range(200)}
        assert r["n_shared"] == (None if r["doc_id"] == 102 else len(covered)), r["doc_id"]
        assert {i for s in r["spans"] for i in range(s["start"], s["start"] + s["length"])} == covered


def test_many_copies_of_one_text(spark):
    text = "".join(random.Random(5).choice("abcdef") for _ in range(400))
    df = spark.range(2000).selectExpr("id as doc_id", f"case when id % 3 = 0 then '{text}' else concat(sha2(cast(id as string), 512), sha2(cast(id + 9999 as string), 512)) end as text")
    assert spans.sharing_records(df.union(df)).count() == 667  # a row repeated in full shares nothing with itself


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_records(df).count() == 0 and spans.spans(df).count() == 0
    with pytest.raises(ValueError):
        spans.sharing_records(df, 100)
