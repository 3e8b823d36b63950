"""Texts sized in tokens, packed into containers of fixed capacity.

Method: sum-of-squares packing. With N(g) open containers of gap g, each text goes where the sum of N(g)^2 over all
gaps becomes smallest: into the open container of a gap g >= size that minimises N(g - size) - N(g), or into a new
one if that is smaller. The rule needs only the counts per gap, so a shard of any number of texts is packed with
`capacity` numbers of state. Texts are spread over shards by a hash of their id; what the shards leave barely
filled is packed again, container by container, in one more pass over those few.
"""

from __future__ import annotations

import base64
import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.session import Cuts

CAPACITY = 2048
#: texts of a shard: its waste is that of a few open containers, so a shard should hold many; and one task must hold it
SHARD_TEXTS = 100_000
#: containers filled less than this are packed again over all shards
LOW_FILL = 0.98


@functools.cache
def _encoding(vocabulary: str):
    """The tokenizer of a vocabulary file of ranks; special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens): the size of each document; null and empty texts have none.

    A row repeated in full is one row; different texts of one id are documents of their own, also of the same size (told apart by a hash of 64 bits).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(2)], names=["doc_id", "n_tokens", "h"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).where("doc_id is not null")
    return texts.mapInArrow(count, "doc_id long, n_tokens long, h long").distinct().drop("h")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each size in turn; a size of 0 shares the first container. Sizes must not exceed the capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; full ones (gap 0) aren't counted
    weight = np.full(capacity + 1, np.iinfo(np.int64).max // 4)  # -count where open, else huge
    open_: dict[int, list[int]] = defaultdict(list)
    out = np.zeros(len(sizes), dtype=np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        # the sum of squares grows by 2 (N(g - s) - N(g)) + 2, for a gap of exactly s by one less, for a new container by 2 N(capacity - s) + 1
        change = count[: capacity + 1 - s] + weight[s:]
        g = int(change.argmin()) + s
        fresh = count[capacity - s] if capacity > s else 0
        if count[g] and (g == s or change[g - s] < fresh):
            at = open_[g].pop()
            count[g] -= 1
            weight[g] = -count[g] if count[g] else np.iinfo(np.int64).max // 4
        else:
            g, at = capacity, n
            n += 1
        out[i] = at
        if g > s:
            left = g - s
            open_[left].append(at)
            count[left] += 1
            weight[left] = -count[left]
    return out


def pack(counts: DataFrame, capacity: int = CAPACITY, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(doc_id, piece_no, container_id, n_tokens, first_token): one row per piece of a document.

    A document of more than capacity tokens is divided into full pieces, each a container of its own, and a rest that
    is packed like any other text; all others stay whole in piece 0. Documents without tokens come into a container
    like any other and use nothing of it. counts: (doc_id, n_tokens). No documents give no rows.
    """
    cuts = Cuts(counts.sparkSession, "packing")
    sized, n, _ = cuts.write(counts)
    full = sized.where(F.col("n_tokens") > capacity).select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n_tokens div {capacity}") - 1)).alias("piece_no"))
    full = full.select("doc_id", "piece_no", F.concat(F.lit("f"), "doc_id", F.lit("."), "piece_no").alias("container_id"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("piece_no") * capacity).alias("first_token"))
    over = F.col("n_tokens") > capacity
    rest = sized.where((F.col("n_tokens") <= capacity) | (F.col("n_tokens") % capacity > 0)).select(
        "doc_id", F.when(over, F.expr(f"n_tokens div {capacity}")).otherwise(0).cast("long").alias("piece_no"), F.when(over, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens")).alias("size"))
    shards = max(1, -(-n // shard_texts))
    hashed = rest.withColumn("h", F.xxhash64("doc_id", "piece_no")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def in_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
        return pdf.assign(container=sum_of_squares(pdf["size"].to_numpy(), capacity))[["doc_id", "piece_no", "size", "shard", "container"]]

    first, _, _ = cuts.write(hashed.groupBy("shard").applyInPandas(in_shard, "doc_id long, piece_no long, size long, shard int, container long"))
    used = first.groupBy("shard", "container").agg(F.sum("size").alias("used"))
    low = used.where(F.col("used") < capacity * LOW_FILL)
    group = max(1, -(-low.count() // shard_texts))

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "shard", "container"], ascending=[False, True, True], kind="stable")
        return pdf.assign(joint=sum_of_squares(pdf["used"].to_numpy(), capacity))[["shard", "container", "g", "joint"]]

    merged = low.withColumn("g", F.pmod(F.xxhash64("shard", "container"), F.lit(group)).cast("int")).groupBy("g").applyInPandas(again, "shard int, container long, g int, joint long")
    named = used.select("shard", "container").join(merged, ["shard", "container"], "left").select(
        "shard", "container", F.coalesce(F.concat(F.lit("m"), "g", F.lit("."), "joint"), F.concat(F.lit("s"), "shard", F.lit("."), "container")).alias("container_id"))
    small = first.join(named, ["shard", "container"]).select("doc_id", "piece_no", "container_id", F.col("size").alias("n_tokens"), (F.col("piece_no") * capacity).alias("first_token"))
    return full.unionByName(small)


def containers(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_pieces, used, unused): how full each container is."""
    return placed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
