import numpy as np
import pytest

from partloom.llm import packing

from ..conftest import rows

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def plain(sizes, capacity):
    """The same rule, spelled out: the place that makes the sum of squared counts smallest; an open one before a new one, a small gap before a large."""
    bins, out = [], []
    for s in sizes:
        if s == 0:
            out.append(0)
            continue
        counts = {}
        for b in bins:
            if b:
                counts[b] = counts.get(b, 0) + 1
        def after(g):
            c = dict(counts)
            if g != "new":
                c[g] -= 1
            left = (capacity if g == "new" else g) - s
            if left:
                c[left] = c.get(left, 0) + 1
            return sum(v * v for v in c.values())
        options = sorted((g for g in counts if g >= s))
        costs = [(after(g), k, g) for k, g in enumerate(options)] + [(after("new"), 10**9, "new")]
        g = min(costs)[2]
        if g == "new":
            bins.append(capacity - s)
            out.append(len(bins) - 1)
        else:
            at = max(i for i, b in enumerate(bins) if b == g)
            bins[at] -= s
            out.append(at)
    return out, bins


@pytest.mark.parametrize("seed", range(4))
def test_rule_against_plain(seed):
    sizes = np.random.default_rng(seed).integers(0, 21, 200)
    got = packing.sum_of_squares(sizes, 20)
    want, bins = plain(sizes.tolist(), 20)
    used = np.bincount(got, sizes)
    assert used.max() <= 20 and len(used) == len(bins)
    assert sorted(used.tolist()) == sorted(20 - b for b in bins)


def test_every_document_once_and_little_waste(spark):
    counts = spark.range(3000).selectExpr("id as doc_id", "case when id % 100 = 0 then 4096 + id % 3 when id % 50 = 1 then 0 else pmod(xxhash64(id), 700) end as n_tokens")
    placed = packing.pack(counts).cache()
    assert placed.select("doc_id").distinct().count() == 3000
    c = packing.containers(placed).cache()
    assert c.where("used > 2048").count() == 0
    total = placed.agg({"n_tokens": "sum"}).first()[0]
    assert total == counts.agg({"n_tokens": "sum"}).first()[0]
    assert c.count() <= total / 2048 * 1.01 + 2
    assert placed.where("piece_no > 0").select("doc_id").distinct().join(counts.where("n_tokens <= 2048"), "doc_id").count() == 0
    few = packing.pack(counts, shard_texts=500)
    assert packing.containers(few).where("used > 2048").count() == 0 and few.count() == placed.count()


def test_pieces_and_edges(spark):
    df = spark.createDataFrame([(1, 5000), (2, 2048), (3, 4096), (4, 0)], "doc_id long, n_tokens long")
    got = rows(packing.pack(df), "doc_id", "piece_no", "n_tokens", "first_token")
    assert got == [(1, 0, 2048, 0), (1, 1, 2048, 2048), (1, 2, 904, 4096), (2, 0, 2048, 0), (3, 0, 2048, 0), (3, 1, 2048, 2048), (4, 0, 0, 0)]
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.where("n_tokens = 0")).select("container_id").distinct().count() == 1


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "Der Preis für 3 Stück\r\n", "x"), (1, "Der Preis für 3 Stück\r\n", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|> word " * 20_000, "x")], "doc_id long, text string, n_tokens string")
    got = dict(rows(packing.token_counts(docs, VOCABULARY)))
    encode = packing._encoding(VOCABULARY)
    assert got[2] == got[3] == 0 and got[1] == len(encode.encode_ordinary("Der Preis für 3 Stück\r\n")) and len(got) == 4 and got[4] > 60_000
    assert encode.decode(encode.encode_ordinary("Der Preis für 3 Stück\r\n")) == "Der Preis für 3 Stück\r\n"
    two = spark.createDataFrame([(7, "one"), (7, "two"), (7, "two")], "doc_id long, text string")
    assert rows(packing.token_counts(two, VOCABULARY)) == [(7, 1), (7, 1)]
