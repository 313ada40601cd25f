"""Removal of passages that an earlier document has, by super-k-mer partitioning.

A window of WINDOW words has a minimiser: the smallest hash of the runs of MINIMISER words in it. Consecutive windows
of one minimiser travel as one packed string of words to the bucket of that minimiser, in which all windows of equal
words meet, whatever document they are of. There they are sorted by hash and compared byte by byte, and those that
begin in a document with a smaller id are marked.

Texts that occur more than once are settled by their digests, so that groups of copies count as one document. Of the
others only packed strings whose minimiser at least two documents have leave their task, as far as a Bloom filter of
FILTER_BYTES at most can tell them; what it lets pass wrongly finds no partner. Minimisers of over HOT_ROWS strings or
HOT_BYTES are not sorted in one task: equal strings become one first, and where still as many are left, their windows
are counted one by one; both are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import append_columns, broadcast_if_small
from quernel.llm.contamination import Shingles, bloom_filter, passes
from quernel.plans.storage import discard, materialize

WINDOW = 13
MINIMISER = 5
FILTER_BYTES = 32 << 20  # of the filter that goes to every task, at most
HOT_ROWS = 2048
HOT_BYTES = 8 << 20
LONGEST = 256  # windows of one packed string
CHUNK = 4 << 20  # bytes of packed strings that are sorted at once


def packed(text: str | None) -> bytes:
    """The words of a text, one space between them: what is not ASCII white space is a word."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


# --- super-k-mers ---------------------------------------------------------------------------------------------------


def runs(shingles: Shingles, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) of the runs of windows of one minimiser in the texts that were read.

    A window is told by its first word; runs stay within a text and have LONGEST windows at most.
    """
    h = shingles.of(minimiser)[0]
    n = len(shingles.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = h[:n].copy()
    for k in range(1, window - minimiser + 1):
        np.minimum(least, h[k : k + n], out=least)
    at = np.flatnonzero(shingles.text[:n] == shingles.text[window - 1 :])  # windows of one text
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    # long runs are cut
    parts = -(-length // LONGEST)
    owner = np.repeat(np.arange(len(begin)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = at[begin[owner]] + nth * LONGEST
    last = np.minimum(first + LONGEST - 1, at[begin[owner]] + length[owner] - 1)
    return least[first].view(np.int64), first, last


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, some megabytes at once and one at least, and where they begin."""
    done, texts, held = 0, [], 0
    for k in range(batch.num_rows):
        texts.append(packed(batch.column(column)[k].as_py()))
        held += len(texts[-1])
        if held >= CHUNK or len(texts) == 256:
            yield done, texts
            done, texts, held = k + 1, [], 0
    if texts:
        yield done, texts


def _minimisers(window: int, minimiser: int):
    """Batches of (doc, text) to (h, least, most, rows, bytes) of each minimiser of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for done, texts in _texts(batch, 1):
                shingles.read(texts)
                h, first, last = runs(shingles, window, minimiser)
                doc = docs[done + shingles.text[first]]
                size = shingles.end[last + window - 1] - shingles.begin[first]
                order = np.argsort(h, kind="stable")
                h, doc, size = h[order], doc[order], size[order]
                cut = np.flatnonzero(np.diff(h, prepend=h[:1] - 1)) if len(h) else np.zeros(0, np.int64)
                if len(cut):
                    ends = [np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut), np.diff(np.append(cut, len(h))), np.add.reduceat(size, cut)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[cut]), *map(pa.array, ends)], names=["h", "least", "most", "rows", "bytes"])

    return run


def _pack(bloom: np.ndarray, window: int, minimiser: int):
    """Batches of (doc, x, text) to packed strings (h, doc, x, first, words) whose minimiser passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for done, texts in _texts(batch, 2):
                shingles.read(texts)
                h, first, last = runs(shingles, window, minimiser)
                found = np.sort(passes(h.view(np.uint64), bloom))
                h, first, last = h[found], first[found], last[found]
                for k in range(0, len(h), 4096):
                    part = slice(k, k + 4096)
                    text = shingles.text[first[part]]
                    rows = pa.array(done + text)
                    begin, end = shingles.begin[first[part]].tolist(), shingles.end[last[part] + window - 1].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[part]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((first[part] - shingles.first[text]).astype(np.int32)), pa.array([shingles.raw[a:b] for a, b in zip(begin, end)], pa.binary())],
                        names=["h", "doc", "x", "first", "words"],
                    )

    return run


# --- buckets --------------------------------------------------------------------------------------------------------


def first_docs(words: list[bytes], docs: np.ndarray, shingles: Shingles, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window in it, smallest document that has its words here) of all windows of packed strings, in their order.

    Windows are sorted by hash, and those of one hash compared; should they differ, all are sorted by their words.
    """
    shingles.read(words)
    h, whole = shingles.of(window)
    at = np.flatnonzero(whole)
    text = shingles.text[at]
    doc = docs[text]
    slices = lambda i: [shingles.raw[a:b] for a, b in zip(shingles.begin[at[i]].tolist(), shingles.end[at[i] + window - 1].tolist())]

    def least(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((doc, key))
        new = np.diff(key[order], prepend=key[order][:1]) != 0
        new[:1] = True
        begin = np.flatnonzero(new)
        return order, np.repeat(order[begin], np.diff(np.append(begin, len(order))))

    if not len(at):
        return at, at, doc
    order, head = least(h[at].view(np.int64))
    others = order != head
    if slices(order[others]) != slices(head[others]):  # hashes that agree by chance
        order, head = least(np.unique(np.array(slices(np.arange(len(at))), object), return_inverse=True)[1])
    owner = np.empty_like(doc)
    owner[order] = doc[head]
    return text, at - shingles.first[text], owner


def later(words: list[bytes], docs: np.ndarray, shingles: Shingles, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window in it) of all windows that a document with a smaller id has here, too."""
    string, place, owner = first_docs(words, docs, shingles, window)
    marked = docs[string] > owner
    return string[marked], place[marked]


def _spans(doc: np.ndarray, x: np.ndarray, place: np.ndarray, string: np.ndarray, window: int) -> pa.RecordBatch:
    """(doc, x, spans): first and stop of runs of marked windows, of which windows of one string stand together."""
    new = np.ones(len(place), bool)
    new[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(place)) - 1
    pairs = np.stack([place[begin], place[last] + window], 1).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * 2), pa.array(pairs.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(x[begin]), spans], names=["doc", "x", "spans"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole minimisers, about CHUNK bytes of ``words`` at once, from batches sorted by the first column, ``h``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            h = batch.column(0).to_numpy()
            if held and size >= CHUNK and h[0] != held[-1].column(0)[-1].as_py():
                yield pa.Table.from_batches(held)
                held, size = [], 0
            # up to the next border of a minimiser from which on there is enough
            length = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("words"))).to_numpy() + 1) + size
            over = np.flatnonzero((length >= CHUNK) & np.append(h[1:] != h[:-1], False))
            stop = int(over[0]) + 1 if len(over) else batch.num_rows
            held.append(batch.slice(0, stop))
            size = int(length[stop - 1])
            batch = batch.slice(stop)
    if held:
        yield pa.Table.from_batches(held)


def _sort(window: int):
    """Batches of packed strings sorted by minimiser to the spans of words that an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for table in _chunks(batches):
            doc, x, first = (table.column(c).to_numpy() for c in ("doc", "x", "first"))
            string, place = later(table.column("words").to_pylist(), doc, shingles, window)
            if len(string):
                yield _spans(doc[string], x[string], first[string] + place, string, window)

    return run


def _owned(window: int):
    """Batches of different strings (h, words, least, most) sorted by minimiser to (h, words, at, owners): windows that a smaller id than ``most`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for table in _chunks(batches):
            least, most = (table.column(c).to_numpy() for c in ("least", "most"))
            string, place, owner = first_docs(table.column("words").to_pylist(), least, shingles, window)
            told = most[string] > owner
            string, place, owner = string[told], place[told].astype(np.int32), owner[told]
            begin = np.flatnonzero(np.diff(string, prepend=-1))
            if len(begin):
                ends = pa.array(np.append(begin, len(string)).astype(np.int32))
                rows = table.select(["h", "words"]).take(pa.array(string[begin])).combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(place)), pa.ListArray.from_arrays(ends, pa.array(owner))], names=["h", "words", "at", "owners"])

    return run


def _windows(window: int):
    """Batches of (h, words, least, most) to the windows (h, words, least, most, at, own) of each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1)[k].as_py().split(b" ")
                n = len(words) - window + 1
                row = batch.take(pa.array(np.full(n, k)))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array(np.arange(n, dtype=np.int32)), pa.array([b" ".join(words[i : i + window]) for i in range(n)], pa.binary())], names=["h", "words", "least", "most", "at", "own"])

    return run


def hot_spans(strings: DataFrame, window: int, hot_rows: int, hot_bytes: int, written: list[DataFrame]) -> DataFrame:
    """The spans of packed strings of hot minimisers.

    Equal strings are one, combined before the shuffle. Minimisers that then have few strings are sorted as others are;
    those with many different ones are not: their windows are grouped one by one, combined before the shuffle. Either
    way a string gets the owners of its windows, and all rows that have it take them from there. Tables that the result
    is read from are added to ``written``.
    """
    each = materialize(strings.groupBy("h", "words").agg(F.min("doc").alias("least"), F.max("doc").alias("most")), "hot-strings")
    sizes = each.groupBy("h").agg(F.count("*").alias("rows"), F.sum(F.octet_length("words")).alias("bytes"))
    split_up = materialize(sizes.where((F.col("rows") > hot_rows) | (F.col("bytes") > hot_bytes)).select("h"), "many")
    many = broadcast_if_small(split_up)
    kind = "h long, words binary, at array<int>, owners array<long>"
    few = each.join(many, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_owned(window), kind)
    split = each.join(many, "h", "left_semi").mapInArrow(_windows(window), "h long, words binary, least long, most long, at int, own binary")
    split = materialize(split, "hot-windows")
    owners = split.groupBy("own").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("own", "first")
    owners = materialize(owners, "owners")
    met = split.join(broadcast_if_small(owners), "own").where("most > first").groupBy("h", "words").agg(F.collect_list(F.struct("at", "first")).alias("o"))
    known = materialize(few.unionByName(met.select("h", "words", F.col("o.at").alias("at"), F.col("o.first").alias("owners"))), "owned")
    for old in (each, split, split_up, owners):
        discard(old)
    written.append(known)
    rows = strings.join(broadcast_if_small(known), ["h", "words"])
    mine = F.filter(F.arrays_zip("at", "owners"), lambda o: o["owners"] < F.col("doc"))
    pairs = F.flatten(F.transform(mine, lambda o: F.array(F.col("first") + o["at"], F.col("first") + o["at"] + window)))
    return rows.select("doc", "x", pairs.alias("spans")).where(F.size("spans") > 0)


# --- documents ------------------------------------------------------------------------------------------------------


def marked_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` as (_row, _text, _doc, _x, _copy): ``_copy`` if a smaller id has the same text; ``_x`` tells texts of one id apart."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text])
    rows = docs.select(row.alias("_row"), docs[f"`{text}`"].alias("_text"), docs[f"`{key}`"].cast("long").alias("_doc"), F.xxhash64(docs[f"`{text}`"]).alias("_x"))
    digest = F.sha2("_text", 256).alias("_digest")
    many = rows.where("_text is not null and _doc is not null").groupBy(digest).agg(F.min("_doc").alias("_least"), F.max("_doc").alias("_most"))
    many = materialize(many.where("_least < _most").select("_digest", "_least"), "copies")
    met = rows.withColumn("_digest", digest).join(broadcast_if_small(many), "_digest", "left")
    return met.select("_row", "_text", "_doc", "_x", F.coalesce(F.col("_doc") > F.col("_least"), F.lit(False)).alias("_copy"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc, x, spans) of ``docs`` (doc, x, text): words of windows that a smaller id has, as first and stop in turn; a written table.

    A text may have several rows, and spans may overlap.
    """
    seen = docs.select("doc", "text").mapInArrow(_minimisers(window, minimiser), "h long, least long, most long, rows long, bytes long")
    seen = seen.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    shared = materialize(seen.where("least < most").select("h", "rows", "bytes"), "minimisers")
    bloom = bloom_filter(shared.select("h"), FILTER_BYTES)
    strings = docs.select("doc", "x", "text").mapInArrow(_pack(bloom, window, minimiser), "h long, doc long, x long, first int, words binary")
    strings = materialize(strings, "strings")
    many = materialize(shared.where((F.col("rows") > hot_rows) | (F.col("bytes") > hot_bytes)).select("h"), "hot")
    hot, written = broadcast_if_small(many), [strings, shared, many]
    few = strings.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    found = few.mapInArrow(_sort(window), "doc long, x long, spans array<int>")
    out = materialize(found.unionByName(hot_spans(strings.join(hot, "h", "left_semi"), window, hot_rows, hot_bytes, written)), "spans")
    for old in written:
        discard(old)
    return out


def covered(text: str | None, spans: list[int], whole: bool, window: int) -> tuple[int, list[tuple[int, int]], str]:
    """(number of words, removed spans, kept words) of a text; ``spans`` has first and stop in turn, ``whole`` stands for all windows."""
    words = packed(text).split(b" ") if text else []
    words = words if words != [b""] else []
    if whole:
        spans = [0, len(words)] if len(words) >= window else []
    if not spans:
        return len(words), [], b" ".join(words).decode("utf-8", "surrogatepass")
    merged: list[list[int]] = []
    for first, stop in sorted(zip(spans[::2], spans[1::2])):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([first, stop])
    kept, done = [], 0
    for first, stop in merged:
        kept += words[done:first]
        done = stop
    return len(words), [tuple(m) for m in merged], b" ".join(kept + words[done:]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, minimiser: int = MINIMISER, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed, removed (spans of words, the end exclusive) and ``text`` as the kept words.

    A word goes if a window that covers it begins in a document with a smaller id, too; windows are judged on the texts
    as they come. Kept words are joined by one space; a null text stays null and has no words, as have empty ones; texts
    of fewer words than a window keep all. Rows without an id neither lose words nor make others lose any. Rows that
    repeat an id don't make each other lose words: each loses what smaller ids have, so equal rows end equal. Columns of the three
    new names that ``docs`` has are replaced; all others stay. ``key`` is an integer. An empty table stays empty.
    """
    new = {"n_words", "n_removed", "removed"}
    source = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in new or c in (text, key)])
    rows = marked_texts(source, text, key)
    single = rows.where("NOT _copy AND _doc is not null AND _text is not null").select(F.col("_doc").alias("doc"), F.col("_x").alias("x"), F.col("_text").alias("text"))
    spans = repeated_spans(single, window, minimiser, hot_rows, hot_bytes)
    by_text = spans.groupBy("doc", "x").agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    by_text = materialize(by_text.select(F.col("doc").alias("_doc"), F.col("x").alias("_x"), "_spans"), "removed")
    discard(spans)
    met = rows.join(broadcast_if_small(by_text), ["_doc", "_x"], "left")
    told = met.select("_row", F.struct("_text", F.when(~F.col("_copy"), F.col("_spans")).alias("_spans"), "_copy").alias("_told"))
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("_kept", T.StringType())]

    def start():
        def work(values: list[dict]) -> tuple[list, list, list]:
            made = [covered(v["_text"], v["_spans"] or [], v["_copy"], window) for v in values]
            return [m[0] for m in made], [[{"first": a, "stop": b} for a, b in m[1]] for m in made], [None if v["_text"] is None else m[2] for v, m in zip(values, made)]

        return work

    out = append_columns(told, start, fields, "_told", keep_source=False)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    own = [F.col("_kept").alias(c) if c == text else F.col("_row")[c].alias(c) for c in source.columns]
    return out.select(*own, "n_words", removed.alias("n_removed"), "removed")
