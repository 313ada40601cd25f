"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's odds are logistic in the summed scores z of its words and a bias b; it
offends with the probability p by which it goes beyond a sentence without telling words, 1 - p = (1 - sigmoid(b + z)) /
(1 - sigmoid(b))^(1 - LEAK), and the document's probability is the noisy-or of its sentences, 1 - prod(1 - p). So a
sentence of harmless words adds next to nothing, and a harmless text scores low however long it is. A word counts once a sentence. Only
documents are labelled: the gradient of the noisy-or's likelihood shares a toxic document's blame among its sentences,
and the fitted sentence scores then locate the offending ones. A word's score is the sum of the weights of its prefixes
and itself, hashed. Weights are never negative: harmless words around an offence don't make up for it.

The bias is learnt with the weights. A few toxic labels are taken to be wrong (``WRONG``), or one without any telling
word would pull weights up for all. The settings of a fit are chosen by folds of the training rows (``compare``), which
never see the held-out ones. Scores are those of the fitted model, every sentence counting.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import append_columns, class_sample, remainder

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
PER_CLASS = 2500  # labelled documents of each class that a fit looks at
BIAS = -6.0  # log-odds of a sentence without telling words that a fit begins with
TOXIC_SHARE = 0.6  # of the likelihood that toxic documents have together, whatever their number
WRONG = 0.1  # share of harmless documents that the likelihood takes to be labelled toxic
LEAK = 0.05  # share of a plain sentence's probability that it keeps
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
EPOCHS = 80
SPARSENESS = 1e-4  # slope of the penalty on the sum of weights
LEAST_DOCUMENTS = 4  # features of fewer training documents have no weight
HALF = math.log(0.5)
KNOWN_WORDS = 400_000
WORD = r"[^\W\d_]+"
SENTENCE = r"[^.!?\n]+"


@dataclass
class Model:
    bias: float
    weights: dict[int, float]  # by hashed feature; absent: 0


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word itself and its proper prefixes."""
    own = [xxhash.xxh32_intdigest("=" + word) % BUCKETS]
    return own + [xxhash.xxh32_intdigest("^" + word[:n]) % BUCKETS for n in PREFIXES if len(word) > n]


def loss(theta, bias, feature, feature_word, words, sentence_of, doc_of, labels, share, wrong: float = WRONG):
    """(negative log-likelihood, its slope by feature, its slope by the bias) of the noisy-or, toxic labels being wrong at a rate.

    ``feature`` and ``feature_word`` pair features with words, ``words`` and ``sentence_of`` words with sentences, and
    ``doc_of`` has the document of each sentence. ``share`` weighs documents.
    """
    n_words, n_sentences, n_docs = int(max(feature_word.max(initial=-1), words.max(initial=-1))) + 1, len(doc_of), len(labels)
    score = np.bincount(feature_word, theta[feature], minlength=n_words)
    z = np.clip(bias + np.bincount(sentence_of, score[words], minlength=n_sentences), -30, 30)
    clean = np.exp(np.bincount(doc_of, (1 - LEAK) * np.logaddexp(0, bias) - np.logaddexp(0, z), minlength=n_docs))
    says = np.where(labels == 1, wrong + (1 - wrong) * (1 - clean), (1 - wrong) * clean)
    # d clean / dz = -clean * p of the sentence; what clean documents say never levels off, however toxic they look
    blame = share * np.where(labels == 1, -(1 - wrong) * clean / np.maximum(says, 1e-9), 1)
    by_sentence = blame[doc_of] / (1 + np.exp(-z))
    by_bias = by_sentence - (1 - LEAK) * blame[doc_of] / (1 + np.exp(-bias))
    by_word = np.bincount(words, by_sentence[sentence_of], minlength=n_words)
    return float(-(share * np.log(np.maximum(says, 1e-300))).sum()), np.bincount(feature, by_word[feature_word], minlength=len(theta)), float(by_bias.sum())


def fit(documents: list[tuple[str, int]], epochs: int = EPOCHS, toxic_share: float = TOXIC_SHARE, wrong: float = WRONG, sparseness: float = SPARSENESS) -> Model:
    """Fit by full-batch Adam on the noisy-or likelihood, toxic documents having ``toxic_share`` of it together.

    ``documents``: (text, 0 or 1). With one class only, or none, every score is that class's rate (0 without rows).
    """
    labels = np.array([y for _, y in documents], float)
    if not len(labels) or labels.min() == labels.max():
        rate = labels[0] if len(labels) else 0.0
        return Model(-20.0 if rate == 0 else 20.0, {})
    sentence_re, word_re = re.compile(SENTENCE), re.compile(WORD)
    index: dict[str, int] = {}
    words, sentence_of, doc_of = [], [], []
    for d, (text, _) in enumerate(documents):
        for part in sentence_re.findall((text or "").lower()):
            found = sorted(set(word_re.findall(part)))
            if found:
                words += [index.setdefault(w, len(index)) for w in found]
                sentence_of += [len(doc_of)] * len(found)
                doc_of.append(d)
    if not doc_of:
        return Model(-20.0, {})
    words, sentence_of, doc_of = np.array(words), np.array(sentence_of), np.array(doc_of)
    per_word = [word_features(w) for w in index]
    feature = np.array([f for fs in per_word for f in fs])
    feature_word = np.repeat(np.arange(len(index)), [len(fs) for fs in per_word])
    # features of too few documents are dropped; what is left is renumbered
    pairs = np.unique(doc_of[sentence_of] * len(index) + words)
    spread = np.bincount(pairs % len(index), minlength=len(index))
    common = np.bincount(feature, spread[feature_word], minlength=BUCKETS) >= LEAST_DOCUMENTS
    stay = common[feature]
    kept, feature = np.unique(feature[stay], return_inverse=True)
    feature_word = feature_word[stay]
    n_docs = len(labels)
    share = np.where(labels == 1, toxic_share / labels.sum(), (1 - toxic_share) / (n_docs - labels.sum()))
    theta, bias = np.zeros(len(kept)), BIAS
    moments = [np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)]
    for epoch in range(1, epochs + 1):
        value, slope, bias_slope = loss(theta, bias, feature, feature_word, words, sentence_of, doc_of, labels, share, wrong)
        slope = np.append(slope + sparseness, bias_slope)
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        step = 0.2 * (moments[0] / (1 - 0.9**epoch)) / (np.sqrt(moments[1] / (1 - 0.99**epoch)) + 1e-5)
        theta, bias = np.maximum(theta - step[:-1], 0), float(bias - step[-1])
    heavy = np.abs(theta) > 1e-3
    return Model(float(bias), dict(zip(kept[heavy].tolist(), theta[heavy].tolist())))


def score_text(text: str | None, model: Model) -> float:
    """The score of one text."""
    clean = 0.0
    for part in re.findall(SENTENCE, (text or "").lower()):
        found = set(re.findall(WORD, part))
        if found:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in found for f in word_features(w))
            clean += (1 - LEAK) * float(np.logaddexp(0, model.bias)) - float(np.logaddexp(0, z))
    return -math.expm1(clean)


def compare(documents: list[tuple[str, int]], settings: list[dict], folds: int = 3) -> list[tuple[dict, float, float, float]]:
    """(setting, recall at THRESHOLD, share of harmless documents at it, likelihood) of each by folds of training rows, the best first.

    A setting is the arguments of ``fit``. The best has the highest recall less ten times the share of false ones.
    """
    out = []
    for setting in settings:
        rows = []
        for fold in range(folds):
            place = lambda text: xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass")) % folds
            model = fit([d for d in documents if place(d[0]) != fold], **setting)
            rows += [(score_text(t, model), y) for t, y in documents if place(t) == fold]
        score, label = np.array(rows, float).T
        says = np.clip(np.where(label == 1, score, 1 - score), 1e-3, 1)
        out.append((setting, float((score[label == 1] >= THRESHOLD).mean()), float((score[label == 0] >= THRESHOLD).mean()), float(np.log(says).mean())))
    return sorted(out, key=lambda r: r[1] - 10 * r[2], reverse=True)


def training_rows(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic) of about ``per_class`` labelled documents of each class, held-out ids left out.

    An id labelled more than once is toxic if one of its labels says so; null ids and labels are left out. Of rows that
    repeat an id one is taken, so that the number of rows is bounded as that of ids is. Other columns are not read.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (remainder("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(class_sample(known, "toxic", "doc_id", per_class))  # about 2 * per_class ids
    return documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit([(r["text"], r["toxic"]) for r in training_rows(documents, labels, per_class).collect()])


def score_documents(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """Append score (0 to 1), predicted (1 from ``threshold`` on) and offending: sentences of probability 0.5 or more.

    Offending sentences are structs of start, end (code points, end exclusive) and score. Null, empty and wordless
    texts score 0. Every sentence of a text counts, however long it is; repeated rows are scored each; columns of
    the three names that ``df`` has already are replaced.
    """

    def start():
        sentence_re, word_re = re.compile(SENTENCE), re.compile(WORD)
        weights, bias = model.weights, model.bias
        plain = (1 - LEAK) * float(np.logaddexp(0, bias))
        known: dict[str, float] = {}

        def word_score(w):
            s = known[w] = sum(weights.get(f, 0.0) for f in word_features(w))
            return s

        def work(texts):
            scores, predicted, offending = [], [], []
            for t in texts:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                clean, bad = 0.0, []
                # lower case letter by letter where it would change positions
                low = (t or "").lower()
                if t and len(low) != len(t):
                    low = "".join(x if len(x) == 1 else c for c in t for x in (c.lower(),))
                for w in set(word_re.findall(low)).difference(known):
                    word_score(w)
                for m in sentence_re.finditer(low):
                    found = set(word_re.findall(m[0]))
                    if found:
                        z = min(30.0, bias + sum(map(known.__getitem__, found)))
                        own = plain - math.log1p(math.exp(z))
                        clean += own
                        if own <= HALF:
                            bad.append({"start": m.start(), "end": m.end(), "score": -math.expm1(own)})
                scores.append(-math.expm1(clean))
                predicted.append(int(scores[-1] >= threshold))
                offending.append(bad)
            return scores, predicted, offending

        return work

    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(place))]
    return append_columns(df, start, fields, text, keep_text)
