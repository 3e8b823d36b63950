"""Evaluation passages that leak into documents, word for word or with changed numbers and names.

Method: template canonicalisation. Numbers, names and units become typed placeholders; windows of consecutive template
words of the passages are joined by hash with those of the documents; where a template window meets, the slots are
compared: equal words in all slots are a verbatim stretch, slots changed the same way throughout are a
re-parameterised one. The windows of the passages are held by every task as one sorted table of hashes, and each
document is read where it lies; only documents that meet a window leave the scan. The passages are taken in blocks
of bounded size, one scan of the documents for each, so any number of them is served.

Names are learned from the passages: a word that is always written with a capital there, also inside sentences, is a name
(not in languages that write all nouns so). In a document any word that no passage has may stand in a name's place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: passage words that every task holds at a time (some 100 MB); more are taken in blocks, one scan of the documents each
BLOCK_WORDS = 1_000_000
#: fixed values: languages that write nouns with a capital, where it tells no name
CAPITAL_NOUNS = ("de", "lb")

# fixed values: unit words that become a placeholder in templates
UNITS = frozenset("mm cm m km kg g mg t l ml h hr hrs min s day days tag tage día días dia dias hour hours stunden horas week weeks wochen semanas percent prozent usd eur pcs pieces nm v a w kw hz bar pa c f".split())

PLACES = pa.list_(pa.struct([(c, pa.int64()) for c in ("template", "verbatim", "changed")]))

_WORD = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")


def words(text: str) -> list[str]:
    """The runs of letters and digits in lower case, without accents; invisible format characters are ignored."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKD", _FORMAT.sub("", text)))
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _WORD.findall(text.lower())


def learned_names(passages: list[tuple[str, str | None]]) -> frozenset[str]:
    """The names of (passage, language): words without digits that are always written with a capital first and then without one, inside sentences too."""
    inside, plain = set(), set()
    for text, lang in passages:
        for m in _WORD.finditer(text):
            w = m.group()
            norm = words(w)
            if len(norm) != 1 or any(c.isdigit() for c in w):
                continue
            named = w[0].isupper() and not w[1:].isupper() and len(w) > 1
            if not named or (lang or "").lower() in CAPITAL_NOUNS:
                plain.add(norm[0])
            elif not re.search(r"(?:^|[.!?:;\n])\W*$", text[: m.start()]):
                inside.add(norm[0])
    return frozenset(inside - plain - UNITS)


def _is_slot(word: str, names: frozenset[str], known: dict[str, int] | None = None) -> str | None:
    """The placeholder of a word, None for ordinary words; known: the words of all passages, where the word is a document's.

    Names are words of letters and digits and those listed, in a document also words that no passage has.
    """
    if word.isdigit():
        return "<number>"
    if any(c.isdigit() for c in word):
        return "<name>"
    if word in UNITS:
        return "<unit>"
    return "<name>" if word in names or (known is not None and names and word not in known) else None


class _Index:
    """The windows of all passages, by template."""

    def __init__(self, items: list[tuple[int, str]], names: frozenset[str] = frozenset()):
        self.items = [(i, w) for i, w in ((i, words(p)) for i, p in items) if w]
        self.names = names
        self.exact: dict[str, int] = {}
        self.ids: dict[str, int] = {"<number>": 1, "<name>": 2, "<unit>": 3}
        exact = self.exact
        starts, templates, verbatim = [], [], []
        for k, (_, w) in enumerate(self.items):
            t = np.array([self._template_id(x, True) for x in w], dtype=np.uint64)
            v = np.array([exact.setdefault(x, len(exact) + 1) for x in w], dtype=np.uint64)
            for j in range(len(w) - WINDOW + 1):
                starts.append((k, j))
            templates.append(self._hashes(t))
            verbatim.append(self._hashes(v))
        self.starts = np.array(starts, dtype=np.int64).reshape(-1, 2)
        empty = np.zeros(0, np.uint64)
        all_t = np.concatenate(templates) if templates else empty
        self.verbatim = np.concatenate(verbatim) if verbatim else empty
        order = np.argsort(all_t, kind="stable")
        self.order, self.sorted = order, all_t[order]
        self.unique = np.unique(all_t)
        self.template_of: dict[str, int] = {}

    def _template_id(self, word: str, grow: bool) -> int:
        slot = _is_slot(word, self.names, None if grow else self.exact)
        return self.ids[slot] if slot else self.ids.setdefault(word, len(self.ids) + 1) if grow else self.ids.get(word, 0)

    @staticmethod
    def _hashes(ids: np.ndarray) -> np.ndarray:
        """Hash of every window; 0 where a window holds a word no passage has."""
        n = len(ids) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        known = np.ones(n, bool)
        for k in range(WINDOW):
            part = ids[k : k + n]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            known &= part > 0
        return np.where(known, h | np.uint64(1), np.uint64(0))

    def _occurrences(self, item: list[str], w: list[str], diagonals: dict[int, list[tuple[int, bool]]]) -> list[tuple[int, int, int]]:
        """(template words, verbatim words, slots changed) of each place where the text holds the passage changed consistently.

        Windows of one diagonal stand together. Of diagonals that claim the same words the one that covers more counts;
        those that follow each other in text and passage (words put in or left out) are one place while their slots agree.
        """
        aligned = []
        for shift, windows in diagonals.items():
            like = sorted({j + k for j, _ in windows for k in range(WINDOW)})
            same = {j + k for j, equal in windows if equal for k in range(WINDOW)}
            swaps: dict[str, set[str]] = {}
            for j in like:
                if item[j] != w[j + shift]:
                    swaps.setdefault(item[j], set()).add(w[j + shift])
            aligned.append((like, same, swaps, shift))
        aligned.sort(key=lambda a: (-len(a[0]), a[3]))
        taken, kept = set(), []
        for like, same, swaps, shift in aligned:
            at = {j + shift for j in like}
            if len(at & taken) < WINDOW:
                taken |= at
                kept.append((like, same, swaps, shift))
        kept.sort(key=lambda a: a[0][0] + a[3])
        open_: list[list] = []
        places = []
        for like, same, swaps, shift in kept:
            start, end = like[0] + shift, like[-1] + shift
            if any(len(v) > 1 for v in swaps.values()):
                continue
            open_ = [o for o in open_ if start - o[4] <= len(item)]
            o = next((o for o in reversed(open_) if like[0] > o[3] and all(o[2].get(x, v) == v for x, v in swaps.items())), None)
            if o is None:
                o = [set(like), set(same), dict(swaps), like[0], end]
                open_.append(o)
                places.append(o)
            else:
                o[0].update(like)
                o[1].update(same)
                o[2].update(swaps)
                o[3], o[4] = like[0], end
        return sorted({(len(o[0]), len(o[1]), len(o[2])) for o in places if o[2]})

    def meet(self, text: str) -> list[tuple[int, int, int, int, int, int, bool, list[tuple[int, int, int]]]]:
        """(item index, item words, verbatim words, template words, runs, slots changed, consistent, places) of each passage the text meets."""
        w = words(text)
        if len(w) < WINDOW:
            return []
        cache = self.template_of
        if len(cache) > 2_000_000:
            cache.clear()
        ids = []
        for x in w:
            t = cache.get(x)
            if t is None:
                t = cache[x] = self._template_id(x, False)
            ids.append(t)
        h = self._hashes(np.array(ids, dtype=np.uint64))
        at = np.searchsorted(self.unique, h)
        at[at == len(self.unique)] = 0
        hits = np.nonzero((h > 0) & (self.unique[at] == h))[0] if len(self.unique) else np.zeros(0, int)
        if not len(hits):
            return []
        exact = np.array([self.exact.get(x, 0) for x in w], dtype=np.uint64)
        vh = self._hashes(exact)
        found: dict[int, list[tuple[int, int, bool]]] = {}
        lo, hi = np.searchsorted(self.sorted, h[hits], "left"), np.searchsorted(self.sorted, h[hits], "right")
        for p, a, b in zip(hits.tolist(), lo.tolist(), hi.tolist()):
            for q in self.order[a:b].tolist():
                k, j = self.starts[q].tolist()
                found.setdefault(k, []).append((j, p, bool(vh[p] == self.verbatim[q])))
        out = []
        for k, meets in found.items():
            item = self.items[k][1]
            same, like = np.zeros(len(item), bool), np.zeros(len(item), bool)
            swaps: dict[str, set[str]] = {}
            diagonals: dict[int, list[tuple[int, bool]]] = {}
            for j, p, equal in meets:
                # the hash only proposes: words and slots are compared
                pairs = list(zip(item[j : j + WINDOW], w[p : p + WINDOW]))
                if equal and all(x == y for x, y in pairs):
                    same[j : j + WINDOW] = like[j : j + WINDOW] = True
                    diagonals.setdefault(p - j, []).append((j, True))
                elif all(x == y or ((slot := _is_slot(x, self.names)) and slot == _is_slot(y, self.names, self.exact)) for x, y in pairs):
                    like[j : j + WINDOW] = True
                    diagonals.setdefault(p - j, []).append((j, False))
                    for x, y in pairs:
                        if x != y:
                            swaps.setdefault(x, set()).add(y)
            runs = int((np.diff(np.concatenate([[0], like.astype(np.int8)])) == 1).sum())
            changed = len(swaps)
            places = self._occurrences(item, w, diagonals) if changed else []
            out.append((k, len(item), int(same.sum()), int(like.sum()), runs, changed, all(len(v) == 1 for v in swaps.values()), places))
        return out


def meetings(items: DataFrame, documents: DataFrame, names: frozenset[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, n_words, n_verbatim, n_template, n_runs, n_changed, consistent, places): one row per passage and document that share a template window.

    n_words: the passage's words; n_verbatim: those in runs of WINDOW or more words that stand in the document the same way;
    n_template: those in such runs up to the words in slots; n_changed: slot words of the passage that stand changed;
    consistent: each of them changed to the same word throughout; places: (template, verbatim, changed) of each place of
    the document where the passage stands changed consistently, whatever else the document holds. Null, empty and shorter texts meet nothing;
    whole texts are read. Rows repeated in full count once. names: instead of those learned from the passages (of each block). Passages are taken in
    blocks of about block_words words, by a hash of their ids; a block is what reaches the driver and the tasks at a time.
    """
    lang = F.col("lang").cast("string") if "lang" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").cast("string").alias("passage"), lang.alias("lang")).where("item_id is not null and passage is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.size(F.split("passage", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_words))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    met = []
    for k in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        passages = [(r[0], r[1], r[2]) for r in mine.orderBy("item_id", "passage").collect()]
        known = learned_names([(p, x) for _, p, x in passages]) if names is None else names
        met.append(_scanned([(i, p) for i, p, _ in passages], texts, known))
    return reduce(DataFrame.unionByName, met).distinct()


def _scanned(passages: list[tuple[int, str]], texts: DataFrame, names: frozenset[str]) -> DataFrame:
    """The meetings of one block of passages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(passages, names)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    out += [(index.items[m[0]][0], doc, *m[1:]) for m in index.meet(text)]
            if out:
                *plain, places = zip(*out)
                places = pa.array([[dict(zip(("template", "verbatim", "changed"), x)) for x in p] for p in places], PLACES)
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in plain], places], names=["item_id", "doc_id", "n_words", "n_verbatim", "n_template", "n_runs", "n_changed", "consistent", "places"])

    return texts.mapInArrow(scan, "item_id long, doc_id long, n_words long, n_verbatim long, n_template long, n_runs long, n_changed long, consistent boolean, places array<struct<template: bigint, verbatim: bigint, changed: bigint>>")


def leaks(met: DataFrame, share: float = 0.5) -> DataFrame:
    """(item_id, doc_id): at least that share of the passage's words lie in verbatim runs."""
    return met.where(F.col("n_verbatim") >= share * F.col("n_words")).select("item_id", "doc_id").distinct()


def reworked(met: DataFrame, share: float = 0.5) -> DataFrame:
    """Documents that hold a passage with changed slots: enough of it as template, changed consistently, and not verbatim enough.

    It is enough that one place of the document is so, or all its meetings together; the figures are those of the place that covers most, or of all.
    """
    least = F.lit(share) * F.col("n_words")
    whole = (F.col("n_template") >= least) & F.col("consistent") & (F.col("n_changed") > 0) & (F.col("n_verbatim") < least)
    best = F.array_max(F.filter("places", lambda p: (p["template"] >= least) & (p["verbatim"] < least)))
    at = met.withColumn("_whole", whole).withColumn("_best", best).where("_whole or _best is not null")
    pick = lambda c: F.when(F.col("_whole"), F.col(f"n_{c}")).otherwise(F.col(f"_best.{c}")).alias(f"n_{c}")
    return at.select("item_id", "doc_id", "n_words", pick("verbatim"), pick("template"), pick("changed"))
