"""Long exact spans shared between records.

Method: difference-cover anchors. Windows of 68 characters are hashed only at positions whose residue modulo 133 lies in
a difference cover of 12 residues. Any two equal stretches of 200 characters hold, within their first 133
characters, a pair of aligned anchors at equal distance from their starts; so every shared stretch meets in a
repeated anchor, though less than a tenth of the positions is hashed. From the repeated anchors the match is
extended: first by 66 characters to either side (two check hashes that travel with the anchor), then every start
that a repeated anchor allows is tried with the hash of its whole window, and equal windows of different
records are joined to stretches.

Nothing is paired: at each step equal hashes are grouped and only "in another record too" is asked, so a stretch in a
third of all records costs what any other stretch costs. Hashes that already repeat within a task go out once.
Hashes travel as packed blocks per hash range, not as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.session import Cuts

MIN_CHARS = 200
#: fixed values: a difference cover of 12 residues modulo 133; every residue is a difference of two of them
PERIOD, COVER = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: hashes that a task gathers before it hands them on, and bits of an anchor's hash
CHUNK, ANCHOR_BYTES = 2_000_000, 5
#: ranges of hashes per split of the input, so that a task that groups hashes has the same load at any size
BUCKETS_PER_SPLIT = 4
#: bound of the filter of candidate records that every task holds; more candidates make it less selective, never wrong
FILTER_BYTES = 32 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 15)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Text:
    """Hashes of any windows of one text, by code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(codes)
        self.up, self.down = _power(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: self.n], out=self.sums[1:])

    def windows(self, start: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.down[start])

    def anchors(self, width: int) -> np.ndarray:
        n = self.n - width + 1
        at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel() if n > 0 else np.zeros(0, np.int64)
        return at[at < n]


def _repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key comes from another record too; and whether it is the first of its key."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    ends = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(k) - 1]]) if len(k) else np.zeros(0, int)
    several = d[new] != d[ends] if len(k) else np.zeros(0, bool)
    rep, first = np.empty(len(k), bool), np.empty(len(k), bool)
    if len(k):
        rep[order], first[order] = several[group], new
    return rep, first


def _squeezed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(a, prepend=a.dtype.type(0)).tobytes()) if len(a) else b""


def _unsqueezed(b: bytes, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind), dtype=kind) if b else np.zeros(0, kind)


#: stands for the record of an entry that is settled already
_SETTLED = np.iinfo(np.int64).min
_BLOCK = "bucket int, key binary, checks binary, doc binary, at binary"


class _Gather:
    """Entries (key, checks, doc, at) of a task, handed on as one block per bucket of keys.

    An entry whose key repeats within the task is settled here: it goes to a block of settled entries (negative
    bucket), and only the first entry of its key is sent as well, without its record, to meet those of other tasks.
    """

    def __init__(self, buckets: int, key_bytes: int, task: int):
        self.buckets, self.bytes, self.task = buckets, key_bytes, task
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, key: np.ndarray, right: np.ndarray, left: np.ndarray, doc: int, at: np.ndarray) -> None:
        self.parts.append((key, right, left, np.full(len(key), doc, np.int64), at.astype(np.int32)))
        self.n += len(key)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        key, right, left, doc, at = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.n = [], 0
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        short = (key >> np.uint64(64 - 8 * self.bytes)) if self.bytes < 8 else key
        settled, send = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for check in (right, left) if len(right) else (None,):
            rep, first = _repeated(key if check is None else _mixed(key ^ check), doc)
            settled |= rep
            send |= ~rep | first
        out_doc = np.where(settled, _SETTLED, doc)
        rows = []
        if settled.any():
            rows.append((-1 - self.task % self.buckets, b"", b"", _squeezed(doc[settled]), _squeezed(at[settled])))
        order = np.nonzero(send)[0]
        order = order[np.argsort(bucket[order], kind="stable")]
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.nonzero(np.diff(ends))[0].tolist():
            mine = order[ends[b] : ends[b + 1]]
            keys = np.ascontiguousarray(short[mine].view(np.uint8).reshape(-1, 8)[:, : self.bytes]).tobytes()
            checks = np.stack([right[mine], left[mine]]).astype(np.uint16).tobytes() if len(right) else b""
            rows.append((b, keys, checks, _squeezed(out_doc[mine]), _squeezed(at[mine])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "key", "checks", "doc", "at"])


def _found_in(key_bytes: int, ats: bool):
    """For one bucket: the entries whose key, with one of its checks, comes from another record too."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = [_unsqueezed(b, np.int64) for b in pdf["doc"]]
        at = np.concatenate([_unsqueezed(b, np.int32) for b in pdf["at"]])
        doc = np.concatenate(docs)
        if pdf["bucket"].iloc[0] >= 0:
            raw = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, key_bytes) for b in pdf["key"]])
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :key_bytes] = raw
            key = wide.view(np.uint64).ravel()
            keep = np.zeros(len(doc), bool)
            sides = [np.frombuffer(b, np.uint16).reshape(2, -1) for b in pdf["checks"]] if len(pdf["checks"].iloc[0]) else []
            for side in (0, 1) if sides else (None,):
                k = key if side is None else _mixed((key << np.uint64(16)) ^ np.concatenate([s[side] for s in sides]))
                # a settled entry comes from another record than every unsettled one of its key, as a record lies in one task
                flags = doc == _SETTLED
                rep, _ = _repeated(k, np.where(flags, _SETTLED + 1 + np.arange(len(doc)), doc))
                keep |= rep & ~flags
            doc, at = doc[keep], at[keep]
        if not len(doc):
            return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "at": pd.Series(dtype=object)})
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        new = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
        pieces = [np.unique(p).astype(np.int32).tobytes() for p in np.split(at, new[1:])] if ats else [b""] * len(new)
        return pd.DataFrame({"doc_id": doc[new], "at": pieces})

    return found


def _grouped(blocks: DataFrame, buckets: int, key_bytes: int, ats: bool = True) -> DataFrame:
    return blocks.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_found_in(key_bytes, ats), "doc_id long, at binary")


def _candidates(documents: DataFrame, min_chars: int, buckets: int) -> DataFrame:
    """(doc_id, at): positions of the anchors that repeat in another record, in blocks."""
    width = min_chars - PERIOD + 1
    reach = (min_chars - width) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gather = _Gather(buckets, ANCHOR_BYTES, TaskContext.get().partitionId())
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None or len(text) < min_chars:
                    continue
                t = _Text(text)
                at = t.anchors(width)
                # a side that would leave the text can't be part of a match that lies mostly there
                right = t.windows(np.minimum(at, t.n - width - reach), width + reach)
                left = t.windows(np.maximum(at - reach, 0), width + reach)
                ok_r, ok_l = at + width + reach <= t.n, at - reach >= 0
                alone = _mixed(at.astype(np.uint64) * np.uint64(_BASE) ^ np.array([doc], np.int64).view(np.uint64))
                low = np.uint64(0xFFFF)
                gather.add(t.windows(at, width), np.where(ok_r, right, alone) & low, np.where(ok_l, left, alone + np.uint64(77)) & low, doc, at)
            if gather.n >= CHUNK:
                yield from gather.blocks()
        yield from gather.blocks()

    return _grouped(documents.mapInArrow(scan, _BLOCK), buckets, ANCHOR_BYTES)


def _filter(ids: DataFrame, n: int):
    """A bit filter of the candidate ids, of bounded size, built in the tasks; the driver only joins equal-sized bit arrays."""
    bits = 1 << max(16, min((FILTER_BYTES * 8).bit_length() - 1, (10 * max(n, 1)).bit_length()))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            h = _mixed(pdf["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(mine, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        yield pd.DataFrame({"bits": [zstandard.ZstdCompressor(level=1).compress(mine.tobytes())]})

    whole = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(8).mapInPandas(build, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row[0])), np.uint8)
    return bits, whole


def shared_starts(documents: DataFrame, min_chars: int = MIN_CHARS, starts: bool = True) -> DataFrame:
    """(doc_id, at): blocks of the positions at which min_chars characters stand that also stand in another record.

    With starts=False at is empty and only the record counts. A record may have several blocks. Null, empty and
    shorter texts share nothing; a stretch that repeats only within its own record isn't shared; rows with the same
    doc_id are one record. min_chars must be
    at least 200: the cover leaves an anchor of min_chars - 132 characters.
    """
    if min_chars < MIN_CHARS:
        raise ValueError(f"the difference cover serves stretches of {MIN_CHARS} characters or more")
    spark = documents.sparkSession
    cuts = Cuts(spark, "spans")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"doc_id is not null and length(text) >= {min_chars}")
    buckets = BUCKETS_PER_SPLIT * docs.rdd.getNumPartitions()
    width = min_chars - PERIOD + 1
    found = _candidates(docs, min_chars, buckets).groupBy("doc_id").agg(F.collect_list("at").alias("ats"))
    cand, n, _ = cuts.write(found)
    bits, held = _filter(cand.select("doc_id"), n)
    shared = spark.sparkContext.broadcast(held)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for b in batches:
            h = _mixed(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) % np.uint64(bits)
            hit = (mine[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
            if hit.any():
                yield b.filter(pa.array(hit.astype(bool)))

    texts = docs.mapInArrow(near, "doc_id long, text string").join(cand.hint("merge"), "doc_id")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gather = _Gather(buckets, 8, TaskContext.get().partitionId())
        none = np.zeros(0, np.uint64)
        for b in batches:
            for doc, text, ats in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = _Text(text)
                steps = np.zeros(t.n + 2, np.int32)
                at = np.concatenate([np.frombuffer(a, np.int32) for a in ats])
                np.add.at(steps, np.maximum(at - (min_chars - width), 0), 1)
                np.add.at(steps, at + 1, -1)
                first = np.nonzero(np.cumsum(steps)[: t.n - min_chars + 1] > 0)[0]
                gather.add(t.windows(first, min_chars), none, none, doc, first)
            if gather.n >= CHUNK:
                yield from gather.blocks()
        yield from gather.blocks()

    return _grouped(texts.select("doc_id", "text", "ats").mapInArrow(extend, _BLOCK), buckets, 8, starts)


def sharing_records(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id): the records that hold a stretch of min_chars characters standing in another record."""
    return shared_starts(documents, min_chars, starts=False).select("doc_id").distinct()


def spans(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, n_shared, share, spans): for each record the characters of it that stand elsewhere too.

    spans: array of (start, length), start from 0, maximal and apart; records that share nothing have n_shared 0 and an
    empty array; a null text has n_chars null and share null, an empty one share 0.
    """
    blocks = shared_starts(documents, min_chars).groupBy("doc_id").agg(F.collect_list("at").alias("ats"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, ats in zip(pdf["doc_id"], pdf["ats"]):
                at = np.unique(np.concatenate([np.frombuffer(a, np.int32) for a in ats])).astype(np.int64)
                gap = np.nonzero(np.diff(at) > min_chars)[0]
                lo, hi = at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + min_chars
                rows.append((doc, int((hi - lo).sum()), [(int(x), int(y - x)) for x, y in zip(lo, hi)]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shared", "spans"])

    found = blocks.mapInPandas(joined, "doc_id long, n_shared long, spans array<struct<start: long, length: long>>")
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    both = sizes.join(found, "doc_id", "left").withColumn("n_shared", F.when(F.col("n_chars").isNotNull(), F.coalesce("n_shared", F.lit(0))))
    share = F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).when(F.col("n_chars") == 0, 0.0)
    return both.select("doc_id", "n_chars", "n_shared", share.alias("share"), F.coalesce("spans", F.expr("array()").cast("array<struct<start: long, length: long>>")).alias("spans"))
