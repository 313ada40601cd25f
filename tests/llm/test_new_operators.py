"""Hard negatives, Merkle manifests and removal of repeated passages against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest

from quernel.llm import merkle, negatives, queries, repeats
from tests.compare import canonical, same_rows
from tests.llm.fixtures import documents, odd_rows, prose

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle_manifest", "op13_substring_dedup"])
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


# --- Merkle manifest ------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def plain_tree(nodes):
    """(root, path of each node): a path has (left, digest) a level, or None."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append((i % 2 == 1, nodes[other]) if other < len(nodes) else None)
            at[k] = i // 2
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0] if nodes else None, paths


def plain_manifest(table):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, text, lang, source, n_chars)."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(one(v) for v in (r[0], r[3], r[2], r[4], r[1])))
    made = [(r[2], (r[0] is not None, r[0] or 0, leaf(r)), r[0]) for r in table]
    langs = sorted({m[0] for m in made}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([m[1][2] for m in sorted((m for m in made if m[0] == g), key=lambda m: m[1])]) for g in langs}
    root, upper = plain_tree([trees[g][0] for g in langs])
    out = []
    for g, above in zip(langs, upper):
        for m, path in zip(sorted((m for m in made if m[0] == g), key=lambda m: m[1]), trees[g][1]):
            out.append((m[2], m[1][2], trees[g][0], root, "".join(s[1] for s in path + above if s)))
    return sorted(out, key=str)


@pytest.mark.parametrize("step", [1, 2, 3, 5])
def test_traversal_gives_every_path(step):
    for n in [1, 2, 3, 5, 8, 13, 16, 31, 33]:
        leaves = [h(str(i)) for i in range(n)]
        root, paths = plain_tree(leaves)
        height = (n - 1).bit_length()
        got = list(merkle.traverse([x.encode() for x in leaves], height, step))
        assert [[None if s is None else s.decode() for s in p] for p, _ in got] == [[None if s is None else s[1] for s in p] for p in paths]
        assert {r.decode() for _, r in got} == {root}
        # more levels than needed: the root is hashed alone
        assert next(merkle.traverse([x.encode() for x in leaves], height + 1, step))[1].decode() == h(root)


def test_desired_subtrees_are_whole_in_time():
    """Two steps a leaf are enough: only the top of a subtree is missing when the walk gets there."""
    for high in range(1, 7):
        tree = merkle.Treehash([b"x"] * 64, 0, high, 0)
        for _ in range(1 << high):
            tree.step(2)
        assert len(tree.nodes) == (2 << high) - 2


ODD = [
    (9, "a", None, "s", 1), (None, "b", None, "s", 2), (3, "c", "", None, 3), (3, "c", "", None, 3), (3, "d", "", "x", None),
    (-5, None, "", "x", 5), (None, None, None, None, None), (2**62, "é\U0001f600", "日本", "x:1-", 2**63 - 1), (7, "x" * 100_000, "en", "x", 7),
]


@pytest.mark.parametrize("block,step", [(1, 1), (2, 1), (3, 2), (12, 3)])
def test_manifest_of_odd_tables(spark, block, step):
    rng = random.Random(4)
    table = ODD + [(i, prose(i, 5), rng.choice(["en", "en", "en", "de"]), "s", i) for i in range(60)]
    rng.shuffle(table)
    df = documents(spark, table).selectExpr("*", "1 as path", "2 as root", "'z' as grp", "0 as pos")
    got = merkle.manifest(df, block=block, step=step)
    from pyspark.sql import functions as F

    told = got.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof"), (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"))
    found = told.collect()
    assert sorted([tuple(r[:5]) for r in found], key=str) == plain_manifest(table)
    assert all(r["ok"] for r in found)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(documents(spark, [])).count() == 0
    one = merkle.manifest(documents(spark, ODD[:1])).collect()
    assert len(one) == 1 and one[0]["path"] == [] and one[0]["leaf"] == one[0]["root"] == one[0]["subroot"]


def test_tampering_shows(spark, sf_dir):
    found = queries.op12_merkle_manifest(spark, sf_dir).collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) == r["verified"] for r in found) and not all(r["verified"] for r in found)


# --- repeated passages ----------------------------------------------------------------------------------------------


def plain_repeats(table, window):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text)."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for d, t in table:
        w = split(t)
        for i in range(len(w) - window + 1) if d is not None else []:
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in table:
        w = split(t)
        gone = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), None if t is None else " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def repeating(seed):
    rng = random.Random(seed)
    passages = [prose(900 + k, rng.randint(10, 60)) for k in range(4)]
    table = [(r[0], r[1]) for r in odd_rows()]
    for i in range(10, 70):
        parts = [prose(rng.randint(0, 30) * 7 + i % 3, rng.randint(1, 40)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        table.append((rng.choice([i, i, 12]), rng.choice([" ", "\n\t", "  "]).join(parts)))
    same = "la " * 2000
    return table + [(80, same), (81, same + "end"), (82, "x " + same), (83, prose(5, 12)), (84, prose(5, 12)), (85, prose(5, 13)), (86, prose(5, 13)), (86, prose(5, 13)), (4, table[-1][1])]


@pytest.mark.parametrize("window,minimiser,hot", [(13, 5, 2048), (13, 5, 1), (4, 2, 3), (3, 3, 2048), (1, 1, 5)])
def test_repeats_against_plain(spark, window, minimiser, hot):
    table = repeating(window)
    df = spark.createDataFrame([(d, t, 5, "a") for d, t in table], "doc_id long, text string, n_words int, h string").repartition(5)
    got = repeats.remove_repeats(df, window=window, minimiser=minimiser, hot_rows=hot)
    assert sorted(got.columns) == ["doc_id", "h", "n_removed", "n_words", "removed", "text"]
    found = got.select("doc_id", "n_words", "n_removed", "text").collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_repeats(table, window)
    for r in got.select("n_removed", "removed").collect():
        assert sum(s["stop"] - s["first"] for s in r["removed"]) == r["n_removed"]


def test_repeats_where_hashes_agree(spark, monkeypatch):
    """Windows are told by their words, not by their hashes."""
    shingles = repeats.Shingles()
    words = [b"a b c", b"d e f", b"a b c", b"d e f", b"g h i"]
    docs = np.array([1, 2, 3, 4, 5])
    right = [x.tolist() for x in repeats.later(words, docs, shingles, 2)]
    assert right == [[2, 2, 3, 3], [0, 1, 0, 1]]
    of = shingles.of
    monkeypatch.setattr(shingles, "of", lambda size: (np.zeros_like(of(size)[0]), of(size)[1]))
    assert [x.tolist() for x in repeats.later(words, docs, shingles, 2)] == right


def test_repeats_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).count() == 0
    null = spark.createDataFrame([(1, None), (2, None), (None, None)], "doc_id long, text string")
    assert {(r["n_words"], r["n_removed"], r["text"]) for r in repeats.remove_repeats(null).collect()} == {(0, 0, None)}


# --- hard negatives -------------------------------------------------------------------------------------------------


def plain_negatives(table, positives=5, number=10, low=30, high=90):
    good = [(i, x, [int(np.floor(256 * float(c))) for c in v]) for i, v, x in table if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    own = {}
    for i, x, v in good:
        if i % 100 == 0:
            own[i] = min(own.get(i, (str(x), v)), (str(x), v))
    out = []
    for a, (label, q) in own.items():
        scored = [(-sum(p * r for p, r in zip(q, v)), i, str(x)) for i, x, v in good if len(v) == len(q)]
        best = sorted((s, i) for s, i, x in scored if x == label and i != a)[:positives]
        for s, p in sorted(set(best)):
            fit = sorted((n, i) for n, i, x in scored if x != label and low * -s <= 100 * -n <= high * -s)[:number]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    table = [(int(i), [float(x) for x in np.float32(centres[i % 4] + 0.4 * rng.standard_normal(dim))], int(rng.integers(0, 3))) for i in range(n)]
    odd = [(300, None, 1), (None, [1.0] * dim, 1), (500, [1.0] * dim, None), (600, [float("nan")] * dim, 1), (601, [None] + [1.0] * (dim - 1), 1), (602, [float("inf")] * dim, 1)]
    odd += [(700, [0.0] * dim, 1), (701, [0.5, 0.25], 1), (1300, [], 1), (1301, [], 1), (1302, [], 2), (800, [0.5, 0.5], 1), (801, [0.25, 0.25], 2), (900, [-1.0] * dim, 9), (1000, [1.0] * dim, 0), (1001, [1.0] * dim, 0), (1002, [0.7] * dim, 1), (1003, [0.7] * dim, 2), (1003, [0.7] * dim, 2), (1000, [1.0] * dim, 0)]
    return table + odd + [(1100 + k, [1e4 * x for x in table[k][1]], k % 3) for k in range(20)]


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "cell": 3, "together": 2}, {"number": 0}, {"number": 1, "block": 50}])
def test_negatives_against_plain(spark, sizes):
    from pyspark.sql import functions as F

    table = vectors(3, 250)
    df = spark.createDataFrame([(i, v, x, 1) for i, v, x in table], "vec_id long, embedding array<float>, label int, id int").repartition(3)
    table = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes)
    found = sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = plain_negatives(table)
    assert len(want) > 50 and found == want


def test_brackets_hold_and_settle_pairs():
    rng = np.random.default_rng(1)
    centres = 300 * rng.standard_normal((6, 16))
    x = np.floor(np.repeat(centres, 50, 0) + 10 * rng.standard_normal((300, 16)))
    square = float((x * x).sum(1).max()) * (1 + 1e-9)
    pivots = negatives.choose_pivots(negatives.augment(x, square), 8)
    near = negatives.distances(negatives.augment(x, square), pivots).astype("<f4").astype(float)
    settled = 0
    for q in x[::25]:
        own = negatives.distances(np.append(q, 0)[None], pivots)[0]
        least, most = negatives.bracket(own, near, near, square, float(q @ q))
        score = x @ q
        assert (least <= score).all() and (score <= most).all()
        settled += (most < np.sort(score)[-40]).mean()
    assert settled / 12 > 0.5  # clustered vectors are mostly settled by their brackets


def test_scores_of_more_than_64_bits_are_an_error(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(100, [1e12, 1e12], 1), (1, [1e12, 1e12], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)


def test_negatives_of_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0


# --- executors without the package ----------------------------------------------------------------------------------

_ELSEWHERE = """
import sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "3g").config("spark.checkpoint.dir", {shared!r}).config("spark.sql.session.timeZone", "UTC").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
def absent(_):
    import importlib.util
    return [importlib.util.find_spec("quernel") is None]
assert all(spark.sparkContext.parallelize(range(4), 4).mapPartitions(absent).collect()), "the package is on the workers' path"
import __spark_entry__ as entry
for name, f in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name in ("pipeline", "secret_base_spans"):
        f(spark, {sf!r}).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_all_queries_on_executors_without_the_package(sf_dir, tmp_path):
    code = _ELSEWHERE.format(here=HERE, shared=str(tmp_path / "shared"), sf=sf_dir)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    ran = {line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")}
    assert done.returncode == 0, done.stderr[-3000:]
    assert ran == set(queries.queries())
