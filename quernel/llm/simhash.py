"""SimHash fingerprints and their near-duplicates.

Fingerprints: every 3-word shingle of a whole text is hashed with XXH64 (seed 42); a bit is 1 if it is set in over half
of them. Near-duplicates differ in 3 bits or fewer.

Search: a fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors is a lower bound of their Hamming distance, and it is the sum of the distances over groups of segments. At a
bound of 3, all groups but three have distance 0: the grid is joined on the cells of each choice of all groups but three
(four groups: each group by itself), within a cell the range of total bit counts (again a lower bound) is searched,
pairs in range are held to the Manhattan distance over all 32 counts, and those within it are verified exactly. More groups make more and finer cells; their number follows from the number of
fingerprints, and every number of groups finds the same links. Only distinct fingerprints take part. A cell yields its
partial components, one row per linked fingerprint, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import append_columns, connected_components, connecting_edges, groups, unite
from quernel.plans.storage import discard, materialize

SEED = 42
WORDS = 3
BITS = 3  # differing bits of linked fingerprints
SEGMENTS = 32
MEETINGS = 1 << 14  # fingerprints that one may be compared with, as expected of random bits, before the grid gets finer
MOST_GROUPS = 8
TILE = 4096  # fingerprints of a cell met at once
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = b" \t\n\x0b\x0c\r"


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the shingles of ``words`` words; 0 for null and for texts without words."""
    # bytes.split() cuts at exactly the six spaces that separate words
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(found) <= words:
        hashes = [digest(join(found), SEED)]
    elif words == 3:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(found, found[1:], found[2:])]
    else:
        hashes = [digest(join(found[i : i + words]), SEED) for i in range(len(found) - words + 1)]
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, np.uint64)
    for i in range(0, len(every), 4096):
        part = np.unpackbits(every[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(0, dtype=np.int32)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, keep_text: bool = False) -> DataFrame:
    """Append ``fingerprint``, the 64 bits as a signed long; null and wordless texts have 0."""

    def start():
        return lambda texts: ([f - (1 << 64) if (f := fingerprint(t, words)) >= 1 << 63 else f for t in texts],)

    return append_columns(df, start, [T.StructField("fingerprint", T.LongType())], text, keep_text)


def choices(count: int, bits: int = BITS) -> list[list[int]]:
    """Segments of each choice of all groups but ``bits``, of ``count`` groups over the segments."""
    if bits >= count:
        raise ValueError(f"{count} groups find up to {count - 1} differing bits")
    members = np.array_split(np.arange(SEGMENTS), count)
    return [np.concatenate(chosen).tolist() for chosen in combinations(members, count - bits)]


def plan(fingerprints: int, bits: int = BITS, meetings: float = MEETINGS) -> int:
    """Groups of the grid: the fewest at which a fingerprint is expected to meet up to ``meetings`` others.

    Two random segments have equal bit counts in 3 of 8 cases.
    """
    for count in range(bits + 1, max(bits + 1, MOST_GROUPS) + 1):
        if fingerprints * sum(0.375 ** len(segments) for segments in choices(count, bits)) <= meetings:
            break
    return count


def cells(fp: str, count: int, bits: int = BITS) -> Column:
    """The grid cells of a fingerprint: for each choice of groups, the bit counts of its segments, two bits each."""
    low = F.lit(0x5555555555555555)
    even, odd = F.col(fp).bitwiseAND(low), F.shiftrightunsigned(F.col(fp), 1).bitwiseAND(low)
    counts = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))

    def mask(segments: list[int]) -> Column:
        value = sum(3 << 2 * s for s in segments)
        return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")

    return F.array(*[F.struct(F.lit(k).alias("cell_group"), counts.bitwiseAND(mask(s)).alias("cell")) for k, s in enumerate(choices(count, bits))])


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments in unary: 0, 1, 2 as 00, 01, 11. Differing bits are the Manhattan distance."""
    low = np.uint64(0x5555555555555555)
    even, odd = fp & low, fp >> np.uint64(1) & low
    return (even | odd) | (even & odd) << np.uint64(1)


def _cell_links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cell_group", "cell", "tile_a", "tile_b"]):
            if group.num_rows < 2:
                continue
            fp = group.column("fp").to_numpy().view(np.uint64)
            node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
            count = np.bitwise_count(fp)
            order = np.lexsort((fp, count))
            fp, node, block, count = fp[order], node[order], block[order], count[order].astype(np.int64)
            unary = unary_counts(fp)
            across = block[0] != block[-1] or (block != block[0]).any()
            upto = np.searchsorted(count, count + bits, "right")
            labels = np.arange(len(fp))
            for i in range(0, len(fp), 256):
                rows = slice(i, min(i + 256, len(fp)))
                columns = slice(i, int(upto[rows].max()))
                near = np.bitwise_count(unary[rows, None] ^ unary[None, columns]) <= bits
                if across:
                    near &= block[rows, None] != block[None, columns]
                a, b = np.nonzero(np.triu(near, 1))
                linked = np.bitwise_count(fp[a + i] ^ fp[b + i]) <= bits
                if linked.any():
                    labels = unite(labels, a[linked] + i, b[linked] + i)
            linked = np.flatnonzero(labels != np.arange(len(fp)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], names=["a", "b"])

    return run


def links(nodes: DataFrame, bits: int = BITS, tile: int = TILE, count: int | None = None) -> DataFrame:
    """Edges (a, b) between rows of ``nodes`` (node, fp; fp distinct) that connect exactly what links within ``bits``.

    At most one edge per fingerprint and tile. Cells of over ``tile`` fingerprints are cut into tiles. ``count`` is the
    number of groups of the grid; without it, that of ``plan``.
    """
    count = count or plan(nodes.count(), bits)
    placed = nodes.withColumn("at", F.explode(cells("fp", count, bits))).select("node", "fp", "at.*")

    def judge(rows: DataFrame) -> DataFrame:
        keys = ["cell_group", "cell", "tile_a", "tile_b"]
        return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cell_links(bits), "a long, b long")

    return connecting_edges(placed, ["cell_group", "cell"], "node", tile, judge)


def near_duplicates(df: DataFrame, text: str = "text", bits: int = BITS, words: int = WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 lower-case hex digits) and component_id.

    component_id is the smallest doc_id reachable over links of ``bits`` or fewer differing bits, itself included;
    equal fingerprints are linked, those of null and wordless texts (zero) like any other. Rows without a doc_id are
    fingerprinted, but take no part in links: their component_id is null. Repeated rows come out each.
    """
    marked = materialize(fingerprints(df.select("doc_id", text), text, words), "fingerprints")
    nodes = materialize(marked.where("doc_id is not null").groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("node")), "nodes")
    joined = connected_components(links(nodes, bits))
    rooted = materialize(
        nodes.join(joined, "node", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("root", "node").alias("component_id")), "components"
    )
    out = marked.join(rooted, "fingerprint", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` without the near-duplicates of an earlier document: of each component the smallest doc_id stays.

    Of rows of that doc_id in the component one stays, the first by text; rows without a doc_id all stay. Rows that
    repeat a doc_id with unlike texts are each in the component of their own text.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("_row"), "doc_id", "text")
    marked = materialize(fingerprints(rows.select("doc_id", "text")).where("doc_id is not null"), "near")
    nodes = materialize(marked.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("fp")).distinct(), "nodes")
    roots = nodes.join(connected_components(links(nodes, bits)), "node", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("root", "node").alias("root"))
    placed = materialize(marked.join(roots, "fingerprint"), "roots")
    # components are told by their fingerprints; of documents, only few ids are in question
    firsts = materialize(placed.groupBy("root").agg(F.min("doc_id").alias("first")), "firsts")
    held = placed.join(firsts, "root")
    ids = held.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("first") == F.col("doc_id"))).alias("leads"))
    fate = materialize(ids.where("n > 1 or not leads").select("doc_id", "leads"), "fate")
    for old in (marked, nodes):
        discard(old)
    kept = rows.join(fate, "doc_id", "left_anti").select("_row.*")
    repeated = fate.where("leads").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = rows.join(repeated, "doc_id", "left_semi")
    own = held.join(repeated, "doc_id", "left_semi").where("first = doc_id").select("doc_id", F.col("fingerprint").alias("_fp"), F.col("root").alias("_root")).distinct()
    told = fingerprints(again.select("doc_id", "text").distinct(), keep_text=True).toDF("doc_id", "_text", "_fp")
    told = told.join(own, ["doc_id", "_fp"]).select(F.col("doc_id").alias("_id"), "_text", "_root")
    met = again.join(told, (F.col("doc_id") == F.col("_id")) & F.col("text").eqNullSafe(F.col("_text")))
    # one whole row of each: the first by text, then by a hash of the row
    once = met.groupBy("doc_id", "_root").agg(F.min_by("_row", F.struct(F.col("text").isNull(), "text", F.xxhash64("_row"))).alias("_row"))
    return kept.unionByName(once.select("_row.*"))
