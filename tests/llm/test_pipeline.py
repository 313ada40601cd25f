"""The five stages against plain versions of what they decide, on nulls, ties, repeats, empty tables and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernel.llm import langid, mixing, secrets, simhash
from tests.llm.fixtures import documents, odd_rows, prose
from tests.llm.test_operators import brute_base, brute_contamination, brute_fingerprint

FRENCH = "ou et le la des que pour avec dans sur une est pas les aux du en qui au ce il elle nous vous être".split()
CLASHING = {"rate": 1, "_unit": 2, "topic": 7, "tokens": "x", "a.b": 3, "toxic": 0, "_hit_0": 4, "score": 5, "lang_pred": "y", "_row": 6, "fingerprint": 8, "spans": "z"}


def french(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(FRENCH) for _ in range(n)) + "."


#: Ids whose labels no model learns from.
WRONG, NONE = [i for i in range(200, 260) if zlib.crc32(str(i).encode()) % langid.FOLDS == langid.HELD_OUT][:2]


def rows():
    out = [(i, prose(i, 40 + i % 30), "en", f"s{i % 3}", 1) for i in range(60)]
    out += [(100 + i, french(i, 40 + i % 30), "fr", f"s{i % 2}", 1) for i in range(40)]
    out += [(WRONG, prose(300, 60), "fr", "s0", 1), (NONE, french(300, 60), None, "s0", 1)]  # wrong label, no label
    out += [(310 + i, prose(3, 43), "en", "s1", 1) for i in range(4)]  # copies of document 3
    out += [(320, prose(77, 30) + ' token = "' + "0123456789abcdef" * 2 + '" ' + prose(78, 10), "en", "s1", 1), (321, "pwd: Zx81kQ93LmPw7Rt2Vb6N " + prose(79, 40), "en", "s2", 1)]
    out += [(330, prose(500, 20) + " " + prose(900, 20), "en", "s2", 1)]  # holds the benchmark's passage
    return out + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in odd_rows()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    documents(spark, rows()).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, prose(900, 20)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_language_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model, grams = langid.train(docs), langid.Grams()
    want = Counter()
    for r in docs.collect():
        votes, total = np.zeros(len(model.languages)), 0
        for piece in grams.pieces(r["text"]):
            mark = np.zeros(1 << langid.BITS, bool)
            grams.mark(piece, mark)
            votes += len(piece) * (mark @ model.weights) / np.sqrt(mark.sum())
            total += len(piece)
        if total:
            e = np.exp(langid.SHARPNESS * votes / total)
            if (e / e.sum()).max() >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
                want[r["doc_id"], r["text"], model.languages[int(e.argmax())]] += 1
    got = corpus_pipeline.identify_language(spark, docs, folder)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == want
    told = {r["doc_id"]: r["lang"] for r in got.collect()}
    assert told[WRONG] == "en" and told[NONE] == "fr"  # the label of the one is corrected, the other gets one
    assert not {1001, 1002, 1003, 1004} & set(told)  # null, empty, blank, no letter


def test_a_document_changes_its_fate_with_its_language(spark, folder):
    """Mixing rakes by the language of the first stage: the same text under a wrong label is sampled as its true language is."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = corpus_pipeline.identify_language(spark, docs, folder)
    cells = lambda d: {(r["lang"], r["source"]) for r in d.where(f"doc_id = {WRONG}").collect()}
    assert cells(docs) == {("fr", "s0")} and cells(told) == {("en", "s0")}
    rate = lambda d: mixing.mix(d).where(f"doc_id = {WRONG}").first()["probability"]
    assert rate(told) != rate(docs)


def test_texts_of_no_one_language_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    english = "the of and to in is that for it".split()
    half = documents(spark, [(5000, " ".join(x for i in range(400) for x in (english[i % 9], FRENCH[i % len(FRENCH)])), "en", "s0", 1)])
    model = langid.train(docs)
    score = langid.predict(half, model).first()["score"]
    kept = corpus_pipeline._scored(half, lambda d: langid.predict(d, model, keep_text=False, least_score=score + 0.01)).count()
    assert kept == 0 and langid.predict(half, model, least_score=score).count() == 1


def test_near_duplicate_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = sorted({(i, brute_fingerprint(t)) for i, t in every if i is not None})
    group = list(range(len(known)))
    for a in range(len(known)):
        for b in range(a):
            if (known[a][1] ^ known[b][1]).bit_count() <= simhash.BITS:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {g: min(known[k][0] for k in range(len(known)) if group[k] == g) for g in set(group)}
    want = Counter()
    for (i, f), g in zip(known, group):
        if i == least[g]:
            want[i, min(t or "" for j, t in every if j == i and brute_fingerprint(t) == f) or None] += 1
    want.update((None, t) for i, t in every if i is None)
    got = Counter((i, t or None) for (i, t), n in ids(corpus_pipeline.drop_near_duplicates(spark, docs, folder)).items() for _ in range(n))
    assert got == want


def test_decontamination_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(1, prose(900, 20))]
    want = Counter((r["doc_id"], r["text"]) for r in docs.collect() if not brute_contamination(r["text"], items)[4])
    got = corpus_pipeline.decontaminate(spark, docs, folder)
    assert ids(got) == want and sum(want.values()) < docs.count() and got.columns == docs.columns


def test_secret_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tagger = secrets.Tagger(secrets.train(docs))
    want = Counter((r["doc_id"], r["text"]) for r in docs.collect() if not (r["text"] and (brute_base(r["text"]) or secrets.without(tagger.spans(r["text"]), [], r["text"]))))
    got = ids(corpus_pipeline.drop_secrets(spark, docs, folder))
    assert got == want and 320 not in {i for i, _ in got}


def test_mixing_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null and source is not null")
    got = corpus_pipeline.mix_sources(spark, docs, folder)
    mixed = mixing.mix(docs).collect()
    key = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(mixing.SEED))).otherwise(F.xxhash64("doc_id", F.lit(mixing.SEED))), F.lit(1 << 52)) / float(1 << 52)
    unit = {(r["doc_id"], r["text"]): r["u"] for r in docs.withColumn("u", key).collect()}
    want = Counter((r["doc_id"], r["text"]) for r in mixed if unit[r["doc_id"], r["text"]] < r["probability"])
    assert ids(got) == want and got.columns == docs.columns
    tokens = {(r["doc_id"], r["text"]): len((r["text"] or "").split()) for r in mixed}
    assert sum(r["probability"] * r["tokens"] for r in mixed) == pytest.approx(mixing.KEEP * sum(r["tokens"] for r in mixed), rel=1e-3)
    assert all(r["tokens"] == tokens[r["doc_id"], r["text"]] for r in mixed if (r["text"] or "").isascii() and "\x1c" not in (r["text"] or ""))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns_and_empty_tables(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    got = stage(spark, wide, folder)
    assert got.columns == wide.columns
    assert ids(got) == ids(stage(spark, docs, folder))
    assert {tuple(r)[len(docs.columns) :] for r in got.collect()} == {tuple(CLASHING.values())}
    empty = stage(spark, wide.limit(0), folder)
    assert empty.columns == wide.columns and empty.count() == 0


def test_run_is_its_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    assert ids(corpus_pipeline.run(spark, folder)) == ids(docs) and docs.count() > 20
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "mixing"]
