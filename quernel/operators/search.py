"""Texts that contain passages: a search for many patterns at once, as joins on anchors.

``contains`` over two tables is a join that equality can't express. Both sides are therefore told by anchors: of every
``q`` consecutive runs of ``q`` bytes (a span), the one with the smallest hash. Whatever text contains a pattern has the
anchors of all spans in the pattern, so that one of them, the rarest in the texts, finds all texts that may contain it;
the text itself decides. Patterns fall into classes by length, with spans as long as fit in the shortest of the class.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.curate import FEW, small
from quernel.plans.storage import discard, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

CLASSES = 5  # runs of 1, 2, 4, 8 and 16 bytes, for patterns of 1, 3, 7, 15 and 31 bytes and more
PIECE = 1 << 20  # bytes of a text that are hashed at once
HELD = 1 << 16  # anchors that are handed on at once


def class_of(length: int) -> int:
    """The class of a pattern of so many bytes: that with the longest span, 2 * 2**class - 1 bytes, that fits in it."""
    return min(CLASSES, (length + 1).bit_length() - 1) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Filter:
    """Hashes of one class as bits at a place of their own, sixteen or more a hash: what has no bit is none of them."""

    bits: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Filter:
        bits = np.zeros(1 << max(10, (16 * len(hashes)).bit_length()), bool)
        bits[hashes.view(np.uint64) & np.uint64(len(bits) - 1)] = True
        return cls(bits)

    def among(self, h: np.ndarray) -> np.ndarray:
        return h[self.bits[h & np.uint64(len(self.bits) - 1)]]


def anchors(text: bytes, classes: list[int], filters: dict[int, Filter] | None = None) -> dict[int, np.ndarray]:
    """By class the distinct anchors of a text, those that pass the filter of their class if any; none where it is shorter than a span."""
    found: dict[int, list[np.ndarray]] = {k: [] for k in classes}
    reach = 2 << max(classes)
    for first in range(0, max(1, len(text)), PIECE):
        piece = np.frombuffer(text[first : first + PIECE + reach], np.uint8)  # pieces overlap by a span
        h = _mixed(piece.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(max(classes) + 1):
            if k:  # runs of twice the length, from two halves
                half = 1 << k - 1
                h = _mixed(h[:-half] * np.uint64(0xC2B2AE3D27D4EB4F) + h[half:]) if len(h) > half else h[:0]
            if k in found:
                least = h
                for j in range(k):  # the least of 2, 4, ... consecutive runs
                    step = 1 << j
                    least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
                found[k].append(np.unique(filters[k].among(least) if filters else least))
    return {k: np.unique(np.concatenate(v)) for k, v in found.items()}


def _anchor_rows(own_class: bool, classes: list[int], filters: dict[int, Filter] | None = None):
    """Batches of (one, two, text) to (one, two, k, h): anchors of the classes that pass the filters, or of a pattern's own class."""

    def flushed(batch: pa.RecordBatch, parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(h) for _, _, h in parts]
        row = pa.array(np.repeat([i for i, _, _ in parts], sizes))
        k = np.repeat(np.array([k for _, k, _ in parts], np.int32), sizes)
        h = np.concatenate([h for _, _, h in parts]).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(k), pa.array(h)], names=["one", "two", "k", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0  # of many texts: a batch for each would cost more than its rows
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                for k, h in anchors(text, [class_of(len(text))] if own_class else classes, filters).items():
                    for j in range(0, len(h), HELD):
                        parts.append((i, k, h[j : j + HELD]))
                        held += len(parts[-1][2])
                        if held >= HELD:
                            yield flushed(batch, parts)
                            parts, held = [], 0
            if parts:
                yield flushed(batch, parts)

    return run


def _filters(known: DataFrame, classes: list[int]) -> dict[int, Filter] | None:
    """Filters of the known anchors (k, h), if they are as few as a side table that goes to all executors; else none."""
    rows = known.limit(FEW + 1).toArrow()
    if rows.num_rows > FEW:
        return None
    k, h = (rows.column(c).to_numpy() for c in ("k", "h"))
    return {c: Filter.of(h[k == c]) for c in classes}


def _told(df: DataFrame, text: str) -> DataFrame:
    """(one, two, text): distinct texts, told by 128 bits; null and empty ones are left out."""
    rows = df.where(F.length(text) > 0).select(F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"), F.col(text).alias("text"))
    return rows.dropDuplicates(["one", "two"])


def containing(docs: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "text") -> DataFrame:
    """(one, two, p_one, p_two): which distinct texts contain which distinct patterns, both told by 128 bits of hash; a written table.

    Null and empty patterns are in no text. Nothing depends on how often a pattern's words occur but the number of
    candidates, of which each is looked at once.
    """
    kind = "one long, two long, k int, h long"
    wanted = materialize(_told(patterns, pattern), "patterns")
    rows = materialize(wanted.mapInArrow(_anchor_rows(True, []), kind).select(F.col("one").alias("p_one"), F.col("two").alias("p_two"), "k", "h"), "pattern-anchors")
    classes = sorted(r[0] for r in rows.select("k").distinct().collect())  # CLASSES values at most
    if not classes:
        return rows.select(F.col("p_one").alias("one"), F.col("p_two").alias("two"), "p_one", "p_two")
    known = materialize(rows.select("k", "h").distinct(), "known-anchors")
    texts = _told(docs, text)
    # most anchors of texts go where they are computed; the join decides on the rest
    met = materialize(texts.mapInArrow(_anchor_rows(False, classes, _filters(known, classes)), kind).join(small(known), ["k", "h"], "left_semi"), "text-anchors")
    seen = materialize(met.groupBy("k", "h").agg(F.count("*").alias("seen")), "seen")
    # a pattern one of whose anchors is in no text is in none; of the others the rarest anchor is asked for
    judged = rows.join(small(seen), ["k", "h"], "left").groupBy("p_one", "p_two").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "k", "h")).alias("a"))
    asked = materialize(judged.where("a.seen > 0").select("p_one", "p_two", "a.k", "a.h"), "asked")
    candidates = materialize(met.join(small(asked), ["k", "h"]).select("one", "two", "p_one", "p_two"), "candidates")
    met_texts = texts.join(small(candidates), ["one", "two"])
    sought = wanted.select(F.col("one").alias("p_one"), F.col("two").alias("p_two"), F.col("text").alias("_sought"))
    out = materialize(met_texts.join(small(sought), ["p_one", "p_two"]).where(F.contains("text", "_sought")).select("one", "two", "p_one", "p_two"), "contained")
    for old in (wanted, rows, met, seen, asked, candidates):
        discard(old)
    return out


def exclude_containing(docs: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text contains none of the patterns; a null text contains none. Only digests are shuffled."""
    found = containing(docs, patterns, text, pattern).select(F.col("one").alias("_one"), F.col("two").alias("_two")).distinct()
    told = [F.xxhash64(docs[f"`{text}`"]).alias("_one"), F.xxhash64(F.lit(1), docs[f"`{text}`"]).alias("_two")]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *told)
    return rows.join(small(found), ["_one", "_two"], "left_anti").select("_row.*")


def contained_pairs(docs: DataFrame, patterns: DataFrame, key: str, pattern_key: str, text: str = "text", pattern: str = "text") -> DataFrame:
    """(``key``, ``pattern_key``): a row for every text and pattern in it, repeated rows each."""
    found = containing(docs, patterns, text, pattern)
    left = docs.where(F.length(text) > 0).select(F.col(key), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))
    right = patterns.where(F.length(pattern) > 0).select(F.col(pattern_key), F.xxhash64(pattern).alias("p_one"), F.xxhash64(F.lit(1), pattern).alias("p_two"))
    return left.join(small(found), ["one", "two"]).join(small(right), ["p_one", "p_two"]).select(key, pattern_key)
