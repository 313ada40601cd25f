"""The noisy-or and its slopes against plain loops, and accuracy on held-out rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import queries, toxicity


def bags(seed=3):
    """(feature, feature_word, words, sentence_of, doc_of, labels): 5 words, 4 features, 7 sentences, 4 documents."""
    rng = random.Random(seed)
    feature = [0, 1, 1, 2, 3, 0]
    feature_word = [0, 0, 1, 2, 3, 4]
    sentences = [[0, 1], [2], [3, 4, 0], [1], [4], [0, 2, 3], [2, 4]]
    words = [w for s in sentences for w in s]
    sentence_of = [k for k, s in enumerate(sentences) for _ in s]
    return [np.array(x) for x in (feature, feature_word, words, sentence_of, [0, 0, 1, 1, 2, 3, 3], [1.0, 0.0, 1.0, 0.0])], np.array([rng.uniform(0, 2) for _ in range(4)])


def plain(theta, bias, feature, feature_word, words, sentence_of, doc_of, labels, share, wrong):
    total = 0.0
    for d, y in enumerate(labels):
        clean = 1.0
        for s in np.flatnonzero(doc_of == d):
            z = bias + sum(theta[f] for w in words[sentence_of == s] for f, v in zip(feature, feature_word) if v == w)
            clean *= (1 - 1 / (1 + math.exp(-z))) / (1 - 1 / (1 + math.exp(-bias))) ** (1 - toxicity.LEAK)  # beyond a sentence without telling words
        says = wrong + (1 - wrong) * (1 - clean)  # only harmless documents are labelled wrongly
        total -= share[d] * math.log(says if y else 1 - says)
    return total


@pytest.mark.parametrize("wrong", [0.0, 0.05])
def test_loss_and_slopes_agree_with_loops(wrong):
    parts, theta = bags()
    share = np.array([0.4, 0.1, 0.35, 0.15])
    value, slope, bias_slope = toxicity.loss(theta, -1.3, *parts, share, wrong)
    assert value == pytest.approx(plain(theta, -1.3, *parts, share, wrong))
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert slope[k] == pytest.approx((plain(theta + step, -1.3, *parts, share, wrong) - plain(theta - step, -1.3, *parts, share, wrong)) / 2e-6, rel=1e-4, abs=1e-8)
    assert bias_slope == pytest.approx((plain(theta, -1.3 + 1e-6, *parts, share, wrong) - plain(theta, -1.3 - 1e-6, *parts, share, wrong)) / 2e-6, rel=1e-4)


def test_scores_are_the_noisy_or_of_all_sentences(spark):
    model = toxicity.Model(-3.0, {toxicity.word_features("vile")[0]: 4.0, toxicity.word_features("rude")[0]: 1.0})
    text = "Some vile words. Rude, rude ones!\n123. Plain ones"
    want = 1.0
    for z in (1.0, -2.0, -3.0):
        want *= (1 - 1 / (1 + math.exp(-z))) / (1 - 1 / (1 + math.exp(3.0))) ** (1 - toxicity.LEAK)
    r = toxicity.score_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r["score"] == pytest.approx(1 - want) and r["predicted"] == (1 - want >= 0.7)
    assert [(text[o["start"] : o["end"]], round(o["score"], 9)) for o in r["offending"]] == [("Some vile words", round(1 - (1 - 1 / (1 + math.exp(-1))) / (1 - 1 / (1 + math.exp(3.0))) ** (1 - toxicity.LEAK), 9))]


def test_held_out_documents(spark):
    """19 of the 279 toxic English documents of sf0.1 have no offending word at all, so that not all can be told."""
    sf_dir = "/root/testdata/sf0.01"
    scored = queries.op2_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    n, found, false, distinct = scored.where("toxic is not null").agg(F.sum("toxic"), F.sum(F.expr("toxic * predicted")), F.sum(F.expr("(1 - toxic) * predicted")), F.countDistinct("score")).first()
    assert found >= 0.85 * n and false <= 2 and distinct > 100


def test_long_harmless_texts_stay_low(spark):
    rng = random.Random(4)
    words = "the of and to in is that for it as with was his on be at by had not".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(". ".join(some(8) for _ in range(rng.choice([1, 5, 40]))) + (". you vile thing" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(docs)
    long = ". ".join(some(8) for _ in range(400))
    got = toxicity.score_documents(spark.createDataFrame([(1, long), (2, long + ". you vile thing")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert got[0]["score"] < 0.7 <= got[1]["score"]


def test_length_alone_makes_no_score(spark):
    """Among held-out harmless documents scores hardly follow length, and planted offences are found where they are."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = docs.join(labels.where("toxic = 0"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).where("n_chars > 0").orderBy("doc_id").select("doc_id", "text").collect()
    score = np.array([toxicity.score_text(r["text"], model) for r in rows])
    assert abs(np.corrcoef(score, np.log([len(r["text"]) for r in rows]))[0, 1]) < 0.3  # 0.22 over the 1,200 of sf0.1
    words = [w for w in {w.lower() for r in docs.join(labels.where("toxic = 1"), "doc_id").select("text").collect() for w in r["text"].split() if w.isalpha()} if model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.word_features(w)) > 2]
    rng, planted = random.Random(5), []
    for r in rows[:60]:
        parts = r["text"].split(". ")
        at = rng.randint(0, len(parts))
        head = ". ".join(parts[:at] + [""])
        planted.append((len(planted), head + f"you are a {rng.choice(sorted(words))} one. " + ". ".join(parts[at:]), len(head)))
    got = toxicity.score_documents(spark.createDataFrame(planted, "doc_id long, text string, place long"), model).collect()
    found = [any(o["start"] <= r["place"] + 12 < o["end"] for o in r["offending"]) for r in got]
    assert words and sum(found) >= 0.95 * len(found) and sum(len(r["offending"]) for r in got) <= 1.3 * len(got)


def test_settings_are_compared_by_folds():
    rng = random.Random(6)
    docs = [(" ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) + (". vile thing" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(150)]
    best = toxicity.compare(docs, [{"epochs": 1}, {}])
    assert best[0][0] == {} and best[0][1] > 0.9 and best[0][2] == 0.0


def test_clashing_columns_of_documents_are_not_read(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x"), (1, "a c", 0, "y"), (2, "d", None, "z")], "doc_id long, text string, toxic int, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels).columns == ["text", "toxic"]
