import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernel.llm import common, contamination, embeddings, langid, licenses, mixing, queries, secrets, simhash, tokens, toxicity, warc
from tests.compare import same_rows
from tests.llm.fixtures import documents, odd_rows, prose


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    documents(spark, odd_rows()).withColumns({"score": F.lit(1), "N_WORDS": F.lit("x"), "spans": F.lit(None).cast("int"), "topic": F.lit(0)}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, 0, 0), (6, 1, 1), (6, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 80)), (2, None), (None, "x y"), (3, ""), (3, "café naïve")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "u\r\nX: y", None), (2, None, "é" * 60), (3, "u", "é" * 60), (4, "u", "s"), (5, "u", "s"), (5, "u", "z" * 200), (5, "u", "z" * 200), (None, "u", "é" * 60)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    v = [1.0] + [0.0] * 7
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0] * 8, 0), (6, [None] + v[1:], 0), (7, [float("nan")] + v[1:], 0), (8, [float("inf")] + v[1:], 0), (9, [2.0, 0.5] + [0.0] * 6, 0), (None, v, 0), (10, [], 0), (11, [1.0, 0.0], 0), (12, [1e-30] + [0.0] * 7, 0), (13, v, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


TABLE = {"op3_embedding_dedup": "embeddings", "op4_warc": "pages"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_and_empty_tables(spark, odd_dir, empty_dir, name):
    run = queries.queries()[name]
    got = run(spark, odd_dir)
    if name in ("op11_hard_negatives", "op12_merkle_manifest", "op13_substring_dedup"):  # row by row
        same_rows(got, queries.oracle_sql()[name], odd_dir)
    elif name != "pipeline":
        assert got.count() == spark.read.parquet(f"{odd_dir}/{TABLE.get(name, 'documents')}.parquet").count()
    else:
        assert got.count() > 0
    assert run(spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_tokens_agree_with_the_library(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    rng = random.Random(4)
    alphabet = "aaabcdeéß ΣσςİI'strelvdm<|endoftext|>日本́ \n\x1c\x85 12_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["aaaaaaaaaaa<|startoftext|><|endoftext|>'s", "aꟋb\ua7dc1 \U00016ea0<|endoftext|>Ა\u0558x \u2603“q”"]
    df = documents(spark, [(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(i + 1000, t, "x", "y", 1) for i, (_, t, *_) in enumerate(odd_rows())])
    df = df.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000).select(*df.columns))
    for r in tokens.count_tokens(df, tokens.vocabulary()).collect():
        t = r["text"] or ""
        assert r["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids), t[:80]
        assert r["n_bytes"] == len(t.encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


def test_merges_agree_with_one_at_a_time():
    merger = tokens.PairMerger(tokens.vocabulary())
    with open(tokens.vocabulary(), encoding="utf-8") as f:
        ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(json.load(f)["model"]["merges"])}

    def slow(word):
        s = [tokens._byte_letters()[b] for b in word]
        s[-1] += merger.suffix
        while True:
            best = min(((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(s, s[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return len(s)
            s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]

    rng = random.Random(2)
    words = [bytes(rng.choice(b"aabbcdeenrst") for _ in range(rng.randint(1, 20))) for _ in range(500)] + [b"a" * n for n in range(1, 20)]
    assert merger.counts(words).tolist() == [slow(w) for w in words]


def test_special_strings_of_another_vocabulary(spark, tmp_path):
    """Whatever they look like, as the library for the same file has them."""
    from tokenizers import Tokenizer

    with open(tokens.vocabulary(), encoding="utf-8") as file:
        spec = json.load(file)
    for token, content in zip(spec["added_tokens"], ("[S]", "##e")):
        token["content"] = content
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    library = Tokenizer.from_file(str(path))
    texts = ["one [S]two##end", "[s] ##E <|endoftext|>", "##", "[S][S]", ""]
    got = tokens.count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), str(path)).collect()
    assert {r["i"]: r["n_tokens"] for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# --- 2 --------------------------------------------------------------------------------------------------------------


def toxic_documents(n):
    rng, out = random.Random(1), []
    for i in range(n):
        parts = [prose(1000 * i + k, rng.randint(4, 40)) for k in range(rng.randint(1, 12))]
        bad = i % 3 == 0
        if bad:
            k = rng.randrange(len(parts))
            parts[k] = parts[k][:-1] + f" {rng.choice(['vile', 'grimwretch', 'grimwretches'])} " + "and."
        out.append((i, " ".join(parts), int(bad)))
    return out


def test_toxicity_learns_from_document_labels(spark):
    rows = toxic_documents(400)
    model = toxicity.fit([(t, y) for _, t, y in rows[:250]])
    df = spark.createDataFrame([(i, t) for i, t, _ in rows[250:]] + [(999, None), (998, ""), (997, "x " * 50_000 + "Grimwretchy!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    right = [got[i]["predicted"] == y for i, _, y in rows[250:]]
    assert np.mean(right) > 0.97
    assert got[999]["score"] == got[998]["score"] == 0 and got[997]["predicted"] == 1
    for i, t, y in rows[250:]:
        assert 0 <= got[i]["score"] <= 1
        if y and got[i]["offending"]:
            assert any(w in t[s["start"] : s["end"]] for s in got[i]["offending"] for w in ("vile", "grimwretch"))


def test_toxicity_of_one_class_and_of_nothing():
    assert toxicity.fit([]).weights == toxicity.fit([("a b", 0)]).weights == {}
    assert toxicity.fit([("a b", 1)]).bias > 0


def test_toxicity_ignores_held_out_labels(spark):
    rows = toxic_documents(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.training_rows(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows)
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


# --- 3 --------------------------------------------------------------------------------------------------------------


def brute_links(rows, cosine=0.93):
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, l), (j, y, m) = good[a], good[b]
            if l == m and len(x) == len(y) and (x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= cosine:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (n[i], find(i)) for i, _, _ in rows}


def vectors(n=240, dim=16):
    rng, out = np.random.default_rng(8), []
    centres = rng.standard_normal((12, dim))
    for i in range(n):
        c = centres[0 if i % 3 == 0 else i % 12]
        out.append((i, (c + rng.standard_normal(dim) * 0.22).astype(np.float32).tolist(), i % 2))
    return out + [(n + i, out[3][1], out[3][2]) for i in range(5)]


@pytest.mark.parametrize("tile", [2048, 16])
def test_vectors_agree_with_brute_force(spark, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    want = brute_links(rows)
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, missed=1e-9, tile=tile).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_shipped_settings_agree_with_brute_force(spark):
    """Counts and components of one label that needs many tables, at the settings of the query."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((9000, 32))
    x[3000:] = x[rng.integers(0, 3000, 6000)] + rng.standard_normal((6000, 32)) * rng.uniform(0.1, 0.5, (6000, 1))
    x = x.astype(np.float32)
    assert embeddings.plan(len(x), 32, embeddings.share_missed(len(x)))[1] > 10
    unit = embeddings.unit_rows(x)
    n, parent = np.zeros(len(x), np.int64), np.arange(len(x))
    for i in range(0, len(x), 500):
        a, b = np.nonzero(np.triu(unit[i : i + 500] @ unit.T >= embeddings.COSINE, i + 1))
        n += np.bincount(a + i, minlength=len(x)) + np.bincount(b, minlength=len(x))
        parent = common.unite(parent, a + i, b)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(4)
    got = embeddings.near_vectors(df).toPandas().sort_values("vec_id")
    assert n.sum() > 1000 and (got["n_links"].to_numpy() == n).all() and (got["component_id"].to_numpy() == parent).all()


def test_rows_of_one_id_with_unlike_vectors(spark):
    v = np.eye(4).tolist()
    rows = [(5, v[0], 0), (5, v[1], 0), (6, v[1], 0), (7, v[2], 0), (3, v[0], 0)]
    got = sorted(tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(3, 1, 3, True), (5, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)])


def test_odd_vectors(spark, odd_dir):
    rows = spark.read.parquet(f"{odd_dir}/embeddings.parquet").collect()
    want = brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in rows if r["vec_id"] is not None])
    got = embeddings.near_vectors(spark.read.parquet(f"{odd_dir}/embeddings.parquet")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want
    assert [tuple(r)[1:] for r in got if r["vec_id"] is None] == [(0, None, False)]


def test_estimates_keep_every_link():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64))
    x[150:] = x[:150] + rng.standard_normal((150, 64)) * 0.3
    x = embeddings.unit_rows(x)
    maybe = embeddings.open_pairs(*embeddings.decode(embeddings.encode(x)), slice(0, 300), 0.93)
    exact = x @ x.T >= 0.93
    assert not (exact & ~maybe).any() and maybe.mean() < 0.02


@pytest.mark.parametrize("dim", [2, 3, 16, 64])
def test_estimates_are_unbiased_within_their_errors(dim):
    """Pairs of one cosine in all directions: mean error near 0, and errors as large as stated."""
    rng = np.random.default_rng(dim)
    n, c = 4000, 0.93
    x, w = (embeddings.unit_rows(rng.standard_normal((n, dim))) for _ in range(2))
    w = embeddings.unit_rows(w - (w * x).sum(1, keepdims=True) * x)
    y = c * x + np.sqrt(1 - c**2) * w
    (a, b, e), (p, q, f) = embeddings.decode(embeddings.encode(x)), embeddings.decode(embeddings.encode(y))
    off = ((a * q).sum(1) + (b * p).sum(1)) / 2 - c
    stated = np.sqrt(((1 - c**2) * (e + f) + e * f) / max(1, dim - 1))
    if dim >= 16:
        assert abs(off.mean()) < 4 * off.std() / np.sqrt(n)
        assert 0.4 < (off / stated).std() <= 1.05
    assert (np.abs(off) <= embeddings.SPREAD * stated + 1e-4).all()


def test_plan_grows_with_the_logarithm():
    assert embeddings.plan(0, 64, 1e-6) == embeddings.plan(embeddings.BUCKET, 64, 1e-6) == ((), 1)
    tables = [embeddings.plan(10**k, 64, embeddings.share_missed(10**k))[1] for k in range(2, 10)]
    assert tables == sorted(tables) and tables[-1] < 200
    for n, dim in ((10**6, 2), (10**6, 3), (10**9, 64)):
        parts, _ = embeddings.plan(n, dim, 1e-6)
        assert all(p <= dim for p in parts) and math.prod(2 * p for p in parts) >= n / embeddings.BUCKET


def test_no_lone_link_at_the_threshold_is_lost(spark):
    """4,000 pairs just over the threshold that nothing else joins, in one label."""
    rng = np.random.default_rng(4)
    x, y = (rng.standard_normal((4000, 256)) for _ in range(2))
    x = embeddings.unit_rows(x)
    y = embeddings.unit_rows(y - (x * y).sum(1, keepdims=True) * x)
    z = 0.93001 * x + np.sqrt(1 - 0.93001**2) * y
    df = spark.createDataFrame([(2 * i + k, v.tolist(), 0) for i in range(4000) for k, v in ((0, x[i]), (1, z[i]))], "vec_id long, embedding array<double>, label int")
    got = embeddings.near_vectors(df)
    assert got.where("n_links <> 1 or component_id <> vec_id - vec_id % 2").count() == 0
    for n in (0, 1, 10**4, 10**8):  # expected losses of a table's tables, and of estimates
        assert (n <= 100 or (n - 1) * embeddings.share_missed(n) <= embeddings.LOST) and n * 0.5 * math.erfc(embeddings.SPREAD / math.sqrt(2)) < 2e-2


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark, odd_dir):
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet")
    path = f"{odd_dir}/warc"
    warc.write_archive(pages, path)
    want = Counter((r["page_id"], (r["html"] or "").encode()) for r in pages.collect())
    got = warc.read_records(spark, path).collect()
    assert Counter((r["page_id"], bytes(r["payload"])) for r in got) == want
    import zstandard

    stored = [zstandard.ZstdDecompressor().decompress(bytes(r["payload"])) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert len({bytes(r["record"]).split(b"WARC-Record-ID: <")[1].split(b">")[0] for r in got}) == len(got)
    assert len(stored) == len(set(stored)) == len({p for _, p in want})
    for r in got:
        head, rest = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[:-4]
        assert rest.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block)
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest()
        assert block.split(b"\r\n\r\n", 1)[1] == (b"" if fields["WARC-Type"] == "revisit" else bytes(r["payload"]))
    index = [tuple(r) for r in warc.read_index(spark, path).where("page_id is not null").collect()]
    kinds = Counter((i, n, k, to) for i, n, _, k, to in index)
    assert kinds == Counter([(1, 0, "response", None), (2, 120, "response", None), (3, 120, "revisit", 2), (4, 1, "response", None), (5, 1, "response", None), (5, 200, "response", None), (5, 200, "revisit", 5)])


def test_damaged_archives_are_told(spark, odd_dir, tmp_path):
    path = str(tmp_path / "bad")
    warc.write_archive(spark.read.parquet(f"{odd_dir}/pages.parquet"), path)
    payloads = spark.read.parquet(f"{path}/payloads")
    import zstandard

    other = zstandard.ZstdCompressor().compress(b"other bytes")
    payloads.withColumn("payload", F.lit(other)).write.parquet(f"{path}/other")
    import shutil

    shutil.rmtree(f"{path}/payloads")
    shutil.move(f"{path}/other", f"{path}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_index(spark, path).collect()


# --- 5 --------------------------------------------------------------------------------------------------------------


def brute_contamination(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, by = split(text), set(), set()
    for item, t in items:
        iw = split(t)
        for i in range(max(1, len(iw) - 12)) if iw else ():
            w = iw[i : i + 13]
            for at in range(len(ws) - len(w) + 1):
                if ws[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    by.add(str(item))
    ids = sorted(by)
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("small", [1 << 25, 0])
def test_contamination_agrees_with_brute_force(spark, small, monkeypatch):
    """With side tables sent to all executors, and with shuffled joins."""
    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (small,))
    rng = random.Random(6)
    items = [(i, prose(i, rng.choice([3, 12, 13, 14, 40]))) for i in range(12)] + [(12, "Ünï-Çödé 7"), (12, prose(3, 20)), (13, "the"), (14, ""), (15, "the the the the"), (16, "of " * 30), (17, "to and of in"), (100, None), (None, "the of")]
    texts = [None, "", "...", "THE", "the " * 40, "Of of " * 12 + "of", "of " * 12 + "and " + "of " * 20, "and to and of in in to and of", "xünï çödé 7", "a ünï çödé 7 b"]
    for k in range(60):
        t = prose(500 + k, rng.randint(1, 200))
        if k % 2:
            _, passage = items[rng.randrange(12)]
            cut = passage.split(" ")[rng.randint(0, 3) :]
            words = t.split(" ")
            at = rng.randint(0, len(words))
            t = " ".join(words[:at] + [w.upper() + "!" for w in cut] + words[at:])
        texts.append(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = contamination.contamination(docs, bench).withColumn("items_sha256", contamination.digest())
    for r in marked.collect():
        want = brute_contamination(r["text"], [x for x in items if x[0] is not None])
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want


# --- 6 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [mixing.SMALL, 0])
def test_raking_meets_its_margins(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL", small)
    rng = random.Random(7)
    rows = [(f"s{i % 5}", f"l{i % 3}", f"t{(i * 7) % 4}", float(rng.randint(10, 10_000)), 1) for i in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double, documents long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
    targets = {m: mixing.tempered(cells, m, 0.3) for m in mixing.MARGINS}
    raked = mixing.rake(cells, targets)
    got = raked.collect()
    # brute force
    t = {m: {r["value"]: r["share"] for r in targets[m].collect()} for m in mixing.MARGINS}
    w = {(r["source"], r["lang"], r["topic"]): r["tokens"] for r in got}
    for _ in range(200):
        for k, m in enumerate(mixing.MARGINS):
            sums = Counter()
            for c, x in w.items():
                sums[c[k]] += x
            w = {c: x * t[m][c[k]] / sums[c[k]] for c, x in w.items()}
    for r in got:
        assert r["weight"] == pytest.approx(w[r["source"], r["lang"], r["topic"]], rel=1e-3)
    for k, m in enumerate(mixing.MARGINS):
        sums = Counter()
        for r in got:
            sums[r[m]] += r["weight"]
        assert all(sums[v] == pytest.approx(s, abs=1e-5) for v, s in t[m].items())


def test_probabilities_are_calibrated(spark):
    docs = documents(spark, [(i, prose(i, 20 + i % 50), ["en", "fr", None][i % 3], f"s{0 if i % 2 else i % 7}", 1) for i in range(3000)])
    mixed = mixing.mix(docs).cache()
    assert mixed.where("probability < 0 or probability > 1 or copies not in (0, 1)").count() == 0
    r = mixed.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum(F.col("tokens") * F.col("copies"))).first()
    assert r[1] == pytest.approx(r[0], rel=0.1)
    again = mixing.mix(docs.repartition(7)).where("copies = 1").select("doc_id")
    assert sorted(again.collect()) == sorted(mixed.where("copies = 1").select("doc_id").collect())
    double = mixing.sample(docs, budget=2.0 * mixed.agg(F.sum("tokens")).first()[0])
    assert double.columns == docs.columns and double.count() > 4000


def test_a_rare_value_does_not_set_the_size_of_the_sample(spark):
    rows = [(i, prose(i, 20 + i % 50), ["en", "fr"][i % 2], f"s{i % 3}", 1) for i in range(3000)]
    for rare in ([], [(9999, prose(7, 30), None, "s0", 1)]):
        mixed = mixing.mix(documents(spark, rows + rare)).cache()
        kept, every, most = mixed.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens"), F.max("probability")).first()
        assert kept / every == pytest.approx(mixing.KEEP, rel=1e-6) and most <= 1
    assert mixed.where("lang is null").first()["probability"] == pytest.approx(1)


def test_margins_that_contradict_each_other_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10.0, 1), ("b", "y", "t", 10.0, 1)], "source string, lang string, topic string, tokens double, documents long")
    shares = lambda **s: spark.createDataFrame(list(s.items()), "value string, share double")
    targets = {"source": shares(a=0.9, b=0.1), "lang": shares(x=0.1, y=0.9)}
    with pytest.warns(UserWarning, match="off its target"):
        raked = mixing.rake(cells, targets, rounds=2)
    assert all(r["margin_gap"] > 0.1 for r in raked.collect())
    with pytest.raises(ValueError, match="off its target"):
        mixing.rake(cells, targets, rounds=1, strict=True)


def test_columns_of_any_name_stay(spark):
    docs = documents(spark, [(i, prose(i, 30), "en", "s", 1) for i in range(40)])
    clashing = docs.withColumns({"topic": F.lit(7), "rate": F.lit(1), "_unit": F.lit(2), "tokens": F.lit("x"), "a.b": F.lit(3), "unit": F.lit(4), "_row": F.lit(5)})
    plain = sorted(r["doc_id"] for r in mixing.sample(docs).collect())
    got = mixing.sample(clashing)
    assert got.columns == clashing.columns and sorted(r["doc_id"] for r in got.collect()) == plain
    assert {tuple(r)[5:] for r in got.collect()} == {(7, 1, 2, "x", 3, 4, 5)}
    mixed = mixing.mix(clashing, topic_of=F.when(F.col("doc_id") < 20, "low"))
    assert {r["topic"] for r in mixed.collect()} == {"low", "unknown"} and "a.b" in mixed.columns


@pytest.mark.parametrize("small", [mixing.SMALL, 0])
def test_capped_raking_agrees_with_bisection(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL", small)
    rng = random.Random(3)
    size = {(f"s{i % 5}", f"l{i % 3}", f"t{(i * 7) % 4}"): float(rng.choice([1, 40, 3000, 100_000])) for i in range(60)}
    cells = spark.createDataFrame([(*k, x, 1) for k, x in size.items()], "source string, lang string, topic string, tokens double, documents long")
    got = mixing.rake(cells, {m: mixing.tempered(cells, m, 0.3) for m in mixing.MARGINS}, keep=0.4).collect()
    cap = {k: x / sum(size.values()) / 0.4 for k, x in size.items()}
    raw = {k: x * 0.4 for k, x in cap.items()}

    def factor(pairs, target):
        low, high = 0.0, 1e12
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(min(c, middle * r) for r, c in pairs) < target else (low, middle)
        return high

    target = []
    for k in range(3):
        most, to = Counter(), Counter()
        for c, x in size.items():
            most[c[k]] += cap[c]
            to[c[k]] += x
        to = {v: x**0.3 for v, x in to.items()}
        f = factor([(x / sum(to.values()), most[v]) for v, x in to.items()], 1 - 1e-12)
        target.append({v: min(most[v], f * x / sum(to.values())) for v, x in to.items()})
    for _ in range(300):
        for k in range(3):
            for v, t in target[k].items():
                own = [c for c in size if c[k] == v]
                f = factor([(raw[c], cap[c]) for c in own], t * (1 - 1e-12))
                raw.update({c: raw[c] * f for c in own if f < 1e11})
    assert sum(r["weight"] for r in got) == pytest.approx(1, rel=1e-6)
    for r in got:
        c = r["source"], r["lang"], r["topic"]
        assert r["weight"] <= cap[c] * (1 + 1e-9) and r["weight"] == pytest.approx(min(cap[c], raw[c]), rel=1e-2, abs=1e-5)


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_languages(spark, sf_dir, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    held = docs.where(common.remainder("doc_id", 4) == 2)
    rows = langid.predict(held, model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[1]["score"] == 0 and got[5]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit([])).collect()} == {"und"}


def test_a_passage_counts_by_its_length(spark):
    french = "ou et le la des que pour avec dans sur une est pas " * 8
    rows = [(prose(i, 60), "en") for i in range(30)] + [(" ".join(french.split()[i:] + french.split()[:i]), "fr") for i in range(30)]
    model = langid.fit(rows)
    df = spark.createDataFrame([(1, prose(99, 700) + french * 3), (2, french * 12 + prose(98, 200))], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(df, model).orderBy("doc_id").collect()] == ["en", "fr"]


def test_documents_stay_where_no_language_is_known(spark):
    import corpus_pipeline

    docs = documents(spark, [(1, "some words", None, "s", 1), (2, "12 ...", None, "s", 1), (3, None, None, "s", 1), (4, "é", None, "s", 1)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


def test_folded_weights_score_as_the_kernel_does():
    rows = [(prose(i, 30), "en") for i in range(20)] + [("ou et le la des " * 5 + str(i), "fr") for i in range(20)]
    model = langid.fit(rows, landmarks=10, keep_support=True)
    row = np.zeros(1 << langid.BITS, bool)
    langid.Grams().mark(langid.Grams().pieces("the and le la of")[0], row)
    kernel = row.astype(float) @ model.support.T / np.sqrt(row.sum())
    assert kernel @ model.coefficients == pytest.approx(row @ model.weights / np.sqrt(row.sum()), rel=1e-3)


def test_language_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(common.remainder("doc_id", 4) == 2, "xx").otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


# --- 8 --------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(odd):
    for t in [None, "", " \n", "A b", "a\x1cb\x85c\xa0d", "é É ß", prose(1, 500), "x " * 9000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    got = {(r["doc_id"], r["text"]): r for r in odd.join(simhash.near_duplicates(odd), "doc_id").collect()}
    assert all(r["fingerprint"] == f"{brute_fingerprint(t):016x}" for (_, t), r in got.items())
    by = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert by[1] == by[2] == by[3] == 1 and by[6] == by[7] == 6 and by[None] is None


@pytest.mark.parametrize("tile,count", [(4096, None), (8, None), (4096, 5), (8, 6), (4096, 8)])
def test_links_agree_with_brute_force(spark, tile, count):
    rng = random.Random(9)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([0, 1, 1, 12])):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(f)
    fps = sorted(fps)
    rng.shuffle(fps)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    roots = {r["node"]: r["root"] for r in common.connected_components(simhash.links(nodes, tile=tile, count=count)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_grid_gets_finer_with_the_number_of_fingerprints():
    counts = [simhash.plan(10**k) for k in range(12)]
    assert counts == sorted(counts) and counts[6] == 4 and counts[10] == 7
    for count in range(4, 9):
        segments = simhash.choices(count)
        assert len(segments) == math.comb(count, 3)
        # whichever three segments differ, a choice without them is left
        for apart in combinations(range(0, 32, 3), 3):
            assert any(not set(apart) & set(s) for s in segments)
    with pytest.raises(ValueError):
        simhash.choices(3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (5, 6)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 81
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9]


def test_rows_of_one_id_with_unlike_texts_are_told_apart(spark):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in [(3, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, a + " " + b), (None, a)]])
    rows = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs).collect())
    assert rows == sorted([(0, a), (3, a), (5, b), (7, c), (7, a + " " + b)])


# --- 9 --------------------------------------------------------------------------------------------------------------


def brute_base(t):
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = rf"""({word}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], a, e) for a, k, e in sorted(out)]


def secret_texts(n=500):
    rng, out = random.Random(12), []
    some = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    for i in range(n):
        t = prose(i, rng.randint(3, 40))
        kind = i % 6
        extra = [f'token = "{some("0123456789abcdef", 40)}"', f"AKIA{some('ABCDEFGH01234567', 16)}", some("0123456789abcdef", rng.randint(29, 36)), f"Api_Key:{some('abcXYZ019_', rng.randint(5, 12))}", f"call {some('0123456789', 12)} now", ""][kind]
        at = rng.randint(0, len(t))
        out.append(t[:at] + " " + extra + " " + t[at:])
    return out + ["PASSWORD=ſecret12 toKen:abcdefgh paſſword=abcdefgh1", "é" * 9 + "f" * 31 + "é" + "0" * 32, "AKIA" * 8, "secret: ''abcdefgh9", "", "12345678 " * 3000]


def test_base_spans_agree_with_plain_patterns():
    for t in secret_texts():
        assert secrets.base_spans(t) == brute_base(t), t


def test_secrets(spark, odd):
    texts = secret_texts()
    model = secrets.fit(texts[:350])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secrets.find_secrets(df, model).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(rows[9999])[2:7] == (0, 0, 0, empty, "")
    for i, t in enumerate(texts):
        base, r = brute_base(t), rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for k, _, _ in base) for n in ("assign", "access", "hex"))
        assert set(base) <= {tuple(s) for s in r["secret_spans"]}
    # values that the base patterns miss by a character or two are found by their shape and neighbours
    near = secrets.find_secrets(spark.createDataFrame([(1, 'the token "24be64439e3e49cf46b2d7c90f3602a3d0b907f" of'), (2, "call 555012345678 now")], "doc_id long, text string"), model)
    assert near.where("doc_id = 2 and spans <> ''").count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = random.Random(3)
    model = secrets.Model({}, [[0.3, -0.2, -1e4], [0.1, 0.5, 0.4], [-0.3, 0.2, 0.6]], [0.2, 0.1, -1e4])
    for _ in range(50):
        e = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(rng.randint(1, 6))]
        value = lambda p: model.starts[p[0]] + sum(x[k] for x, k in zip(e, p)) + sum(model.moves[a][b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert value(secrets.viterbi(e, model)) == pytest.approx(max(map(value, product(range(3), repeat=len(e)))))


# --- 10 -------------------------------------------------------------------------------------------------------------

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def licences(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in licenses.scan_licences(df).orderBy("doc_id").collect()]


def test_licences(spark):
    a, b, c, d, e, f = licences(spark, APACHE, "x.\nReleased under the MIT License.", None, "Prose about a license. No licence here.", "Some line\nlicensed under  CC BY-NC 4.0", "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.\n" * 2)
    assert a["licenses"] == ["Apache-2.0"] and a["n_sentences"] == 5 and len(a["license_spans"]) == 1
    assert b["licenses"] == ["MIT"] and "x.\nReleased under the MIT License."[b["license_spans"][0]["start"] : b["license_spans"][0]["end"]] == "Released under the MIT License"
    assert c["licenses"] == d["licenses"] == [] and e["licenses"] == ["CC-BY-NC-4.0"]
    assert f["licenses"] == ["GPL-3.0", "MIT"] and len(f["license_spans"]) == 4


ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_wrapped_notices_in_comments(spark):
    for text, name, n in ((ISC, "ISC", 1), (MIT, "MIT", 3), (APACHE, "Apache-2.0", 5)):
        bodies = [f"Copyright (c) 2020 Jane Doe\n\n{text}", f"Copyright (c) 2020 Jane Doe\n{text}"]
        heads = [t for body in bodies for t in ("/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in body.split("\n")) + " */\nint x;", *("".join(f"{m} {x}".rstrip() + "\n" for x in body.split("\n")) + "x = 1" for m in ("#", "//", "--", ";;")))]
        for r, t in zip(licences(spark, *heads), heads):
            assert (r["licenses"], r["n_sentences"]) == ([name], n), t
            assert name == "Apache-2.0" or "Permission" in t[r["license_spans"][0]["start"] :].split("\n")[0]
    ended = licences(spark, " * Released under the MIT License\n *\n * int main here\n")[0]
    assert ended["licenses"] == ["MIT"]


def test_rules_are_ordered_and_bounded():
    rules = licenses.Rules.of({"a": "first one", "b": "second one"}, [("L", ["a", "b"])])
    match = lambda *f: licenses.match_rules([(k, 10 * k, 10 * k + 5, n) for k, n in f], rules, gap=2)
    assert match((0, "a"), (3, "b")) == [("L", 0, 35)] and match((0, "a"), (4, "b")) == [] and match((0, "b"), (1, "a")) == []
    assert match((0, "a"), (1, "a"), (2, "b")) == [("L", 0, 25)]
