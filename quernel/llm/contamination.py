"""Benchmark decontamination by a prefix-filtered set join.

Every window of WINDOW consecutive item words (an item of fewer words is one window) is sought in the documents as a
whole. Windows and documents are sets of shingles of SHINGLE words (of all its words, for a shorter window). Shingles
are ordered by rarity, counted over all texts of documents. Containment of a whole window needs all its shingles, so its
necessary prefix is one, the rarest; windows with a shingle that occurs nowhere have no occurrence and drop out. Prefix
shingles are joined with the shingles of documents. A shingle's place in its window fixes where the occurrence would
begin; positional and length bounds drop those that would run over an end of the document, and the words of the
item-sized window are compared one by one.

A pass over the documents emits only shingles that pass a Bloom filter of the items' shingles, with the words around them:
what it lets pass wrongly falls out in the join. A filter has FILTER_BYTES at most and FILTER_BITS a shingle at least, so
that about one shingle in 50 passes wrongly: items of more shingles than that have several filters, by ranges of the
shingles' hash, and a pass for each. Up to some 13 million shingles of items that is one pass.
Texts are told by 128 bits, so equal texts take part once, and nothing but those digests travels for a document that
shares no shingle with an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import append_columns, broadcast_if_small
from quernel.plans.storage import discard, materialize

WINDOW = 13
SHINGLE = 5
SHARE = 20  # contaminated from one word in so many on
FILTER_BYTES = 16 << 20  # of the filter that goes to every task, at most
FILTER_BITS = 10  # of a filter for each shingle, at least
HASHES = 3  # bits of a shingle in the filter
PIECE = 1 << 20  # bytes of text whose words are hashed at once
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and whatever is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


# --- shingles -------------------------------------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingles:
    """Places and hashes of the words of many texts at once, and of their shingles."""

    def __init__(self):
        self.up, self.down = _powers(PIECE + 1)

    def read(self, texts: list[bytes]) -> None:
        """Words of ``texts`` (normalised bytes): where they begin and end, which text has them, and their hashes."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.raw = b" ".join(texts) + b" "
        self.borders = np.concatenate([[0], np.cumsum(sizes)])
        every = np.frombuffer(self.raw, np.uint8)
        letter = every != 32
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.begin, self.end = edge[::2], edge[1::2]
        self.hash = np.empty(len(self.begin), np.uint64)
        first = 0
        while first < len(self.begin):
            at = int(self.begin[first])
            last = max(first + 1, int(np.searchsorted(self.end, at + PIECE, "right")))
            stop = int(self.end[last - 1])
            if stop - at > PIECE:  # one word longer than a piece
                self.up, self.down = _powers(stop - at + 1)
            value = (every[at:stop].astype(np.uint64) + np.uint64(1)) * self.up[: stop - at]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            b, e = self.begin[first:last] - at, self.end[first:last] - at
            self.hash[first:last] = _mix((total[e] - total[b]) * self.down[b])
            first = last
        self.text = np.searchsorted(self.borders, self.begin, "right") - 1
        self.first = np.searchsorted(self.begin, self.borders)  # first word of each text, and the number of words

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether all words are of one text) of the ``size`` words from each word on."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.full(n, np.uint64(size), np.uint64)
        for k in range(size):
            out = (out + self.hash[k : k + n]) * np.uint64(0x94D049BB133111EB + 2 * k)
        return _mix(out), self.text[:n] == self.text[size - 1 :]


def window_rows(item: str | None, text: str | None, window: int, shingle: int, shingles: Shingles) -> list[tuple]:
    """(item, words, n, size, hashes) of the distinct windows of an item; ``size`` words are one shingle."""
    ws = words(text)
    if not ws:
        return []
    n = min(window, len(ws))
    size = min(shingle, n)
    shingles.read([b" ".join(ws)])
    hashes = shingles.of(size)[0].view(np.int64).tolist()
    made = {}
    for i in range(len(ws) - n + 1):
        key = b" ".join(ws[i : i + n])
        if key not in made:
            made[key] = (item, key.decode("utf-8", "surrogatepass"), n, size, hashes[i : i + n - size + 1])
    return list(made.values())


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, words, n, size, hashes, w1, w2): distinct windows of every item; w1 and w2 tell a window's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = window_rows(i, t, window, shingle, shingles)
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k_) for c, k_ in zip(zip(*rows[k : k + 4096]), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["item", "words", "n", "size", "hashes"])

    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    found = known.mapInArrow(run, "item string, words string, n int, size int, hashes array<long>")
    return found.withColumns({"w1": F.xxhash64("words"), "w2": F.xxhash64(F.lit(1), "words")})


# --- filter ---------------------------------------------------------------------------------------------------------


def _bit(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return _mix(h + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1)) & np.uint64(bits - 1)


def bloom_filter(hashes: DataFrame, most_bytes: int = FILTER_BYTES) -> np.ndarray:
    """A Bloom filter of the column ``h``, 64 bits a word: about 32 bits a shingle, ``most_bytes`` at most.

    Built by the executors; the driver gets the words that are not 0.
    """
    number = hashes.agg(F.approx_count_distinct("h")).first()[0]
    bits = 1 << max(10, min((most_bytes * 8).bit_length() - 1, (32 * max(1, number)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            for k in range(HASHES):
                at = _bit(h, k, bits)
                np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        place = np.flatnonzero(own)
        for i in range(0, len(place), 1 << 16):
            part = place[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own[part].view(np.int64))], names=["place", "word"])

    out = np.zeros(bits // 64, np.uint64)
    rows = hashes.select("h").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word"))
    found = rows.toArrow()
    out[found.column("place").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


def passes(h: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    out = np.arange(len(h))
    for k in range(HASHES):
        at = _bit(h[out], k, 64 * len(bloom))
        out = out[(bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return out


# --- join -----------------------------------------------------------------------------------------------------------


def _digest(text: str) -> dict[str, Column]:
    return {"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)}


_MATCH = "t1 long, t2 long, total int, h long, size int, place int, before int, words string"


def _scan(bloom: np.ndarray, sizes: list[int], window: int, ranges: int = 1, own: int = 0):
    """Batches of (t1, t2, text) to the shingles of one of ``ranges`` that pass its filter, with the words that a window around one can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                # texts of some megabytes at once, one at least
                texts, held = [], 0
                while done + len(texts) < batch.num_rows and len(texts) < 256 and held < 4 << 20:
                    texts.append(batch.column(2)[done + len(texts)].as_py().encode("utf-8", "surrogatepass").translate(_WORDS))
                    held += len(texts[-1])
                shingles.read(texts)
                for size in sizes:
                    h, whole = shingles.of(size)
                    if ranges == 1:
                        found = passes(h, bloom)
                    else:
                        found = np.flatnonzero(h.view(np.int64) % ranges == own)
                        found = found[passes(h[found], bloom)]
                    found = found[whole[found]]
                    for i in range(0, len(found), 4096):
                        at = found[i : i + 4096]
                        text = shingles.text[at]
                        low = np.maximum(at - (window - size), shingles.first[text])
                        high = np.minimum(at + window, shingles.first[text + 1]) - 1
                        around = [b" ".join(shingles.raw[a:b].split()) for a, b in zip(shingles.begin[low].tolist(), shingles.end[high].tolist())]
                        rows = pa.array(done + text)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((shingles.first[text + 1] - shingles.first[text]).astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), size, np.int32)),
                             pa.array((at - shingles.first[text]).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array([w.decode("utf-8", "surrogatepass") for w in around], pa.string())],
                            names=["t1", "t2", "total", "h", "size", "place", "before", "words"],
                        )
                done += len(texts)

    return run


def occurrences(docs: DataFrame, found: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(t1, t2, total, w1, w2, first, n): where windows of ``found`` (see ``windows``, a written table) occur in texts of ``docs`` of ``total`` words."""
    spark = docs.sparkSession
    sizes = sorted(r[0] for r in found.select("size").distinct().collect())  # SHINGLE values at most
    schema = "t1 long, t2 long, total int, w1 long, w2 long, first int, n int"
    if not sizes:
        return spark.createDataFrame([], schema)
    hashes = found.select(F.explode("hashes").alias("h"))
    number = hashes.agg(F.approx_count_distinct("h")).first()[0]
    ranges = max(1, -(-number * FILTER_BITS // (8 * FILTER_BYTES)))
    texts = docs.where(F.col(text).isNotNull()).select(*[c.alias(n[1:]) for n, c in _digest(text).items()], text)
    matches = None
    for own in range(ranges):
        bloom = bloom_filter(hashes if ranges == 1 else hashes.where(F.pmod("h", F.lit(ranges)) == own), FILTER_BYTES)
        part = texts.mapInArrow(_scan(bloom, sizes, window, ranges, own), _MATCH)
        matches = part if matches is None else matches.unionByName(part)
    matches = materialize(matches.dropDuplicates(["t1", "t2", "size", "place"]), "matches")
    rarity = materialize(matches.groupBy("h", "size").agg(F.count("*").alias("seen")), "rarity")
    each = found.select("w1", "w2", "words", "n", "size", "hashes").dropDuplicates(["w1", "w2"])
    shingled = each.select("w1", "w2", "n", "size", F.size("hashes").alias("shingles"), F.posexplode("hashes").alias("offset", "h"))
    ordered = shingled.join(broadcast_if_small(rarity), ["h", "size"])
    # windows all of whose shingles occur; of those the rarest is the prefix
    prefix = ordered.groupBy("w1", "w2").agg(F.count("*").alias("of"), F.first("shingles").alias("shingles"), F.min(F.struct("seen", "offset", "h")).alias("p"))
    prefix = prefix.where("of = shingles").select("w1", "w2", "p.h", "p.offset")
    prefix = materialize(prefix.join(each.select("w1", "w2", "n", "size", F.col("words").alias("wanted")), ["w1", "w2"]), "prefixes")
    met = matches.join(broadcast_if_small(prefix), ["h", "size"])
    held = F.split("words", " ")
    inside = (F.col("place") >= F.col("offset")) & (F.col("place") - F.col("offset") + F.col("n") <= F.col("total"))
    same = F.array_join(F.slice(held, F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("wanted")
    out = met.where(inside).where(same).select("t1", "t2", "total", "w1", "w2", (F.col("place") - F.col("offset")).alias("first"), "n")
    out = materialize(out, "occurrences")
    for old in (matches, rarity, prefix):
        discard(old)
    return out


def text_hits(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(t1, t2, total, n_hit, items) of every text with an occurrence; a written table of one row a text."""
    found = materialize(windows(items, window, shingle), "windows")
    hits = occurrences(docs, found, text, window)
    spans = hits.groupBy("t1", "t2", "total", "first").agg((F.col("first") + F.max("n")).alias("stop"))
    order = Window.partitionBy("t1", "t2").orderBy("first")
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = spans.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("first", reached)))
    counts = new.groupBy("t1", "t2", "total").agg(F.sum("new").alias("n_hit"))
    owners = found.select("w1", "w2", "item").distinct()
    named = hits.select("t1", "t2", "w1", "w2").distinct().join(broadcast_if_small(owners), ["w1", "w2"])
    names = named.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return materialize(counts.join(names, ["t1", "t2"]), "hits")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", size: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Append n_words, n_hit, n_items, items (their ids as sorted strings) and contaminated to every row of ``docs``.

    A word is hit if it lies in an occurrence of a window; a document is contaminated if n_hit > 0 and
    ``SHARE`` * n_hit >= n_words. Null and wordless texts have no words and no hits; items without id, text or words
    have no windows; without items nothing is hit. Repeated documents come out each; repeated items count once by id.
    Columns of the five names that ``docs`` has already are replaced; all others stay, whatever their names.
    """
    new = {"n_words", "n_hit", "n_items", "items", "contaminated"}
    hits = text_hits(docs, items, text, size)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in new and (keep_text or c != text)])
    marked = docs.select(row.alias("_row"), docs[f"`{text}`"].alias("_text"), *[c.alias(n) for n, c in _digest(text).items()])
    count = lambda: lambda texts: ([len(words(t)) for t in texts],)
    marked = append_columns(marked, count, [T.StructField("n_words", T.LongType())], "_text", keep_source=False)
    hits = broadcast_if_small(hits.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "n_hit", "items"))
    out = marked.join(hits, ["_t1", "_t2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("_row.*", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"), ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"))


def digest(items: str = "items"):
    """SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, with its own columns.

    A text decides for all rows that have it. Null and wordless texts stay, as does everything without items.
    """
    hits = text_hits(docs, items)
    bad = hits.where(F.col("n_hit") * SHARE >= F.col("total")).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in _digest("text").items()])
    return rows.join(broadcast_if_small(bad), ["_t1", "_t2"], "left_anti").select("_row.*")
