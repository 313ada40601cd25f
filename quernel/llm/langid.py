"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of character n-grams (orders 1 to 3) present in both,
over the root of the product of their numbers. Nystroem landmarks approximate it, one-versus-rest kernel ridge
regression is solved in the landmarks' space, and texts are scored in batches: presence matrix times coefficients.
The kernel is an inner product of presence vectors, so landmarks and coefficients fold into one matrix of n-grams by
languages; scores are the same as through the landmarks.

Long texts are sums of pieces of PIECE code points, every piece weighing as much as it is long: a passage in another
language then counts by its length and not by how many new n-grams it brings.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import append_columns, class_sample, remainder

BITS = 16
ORDERS = 3
PIECE = 1000  # code points
PIECES = 500  # of each language that a fit looks at, dealt by a hash of the piece
PER_LANGUAGE = 400  # labelled documents of each language that a fit looks at
LANDMARKS = 240
RIDGE = 1e-2
SHARPNESS = 6.0
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_FOLD = 0x250


def _folded() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of the first code points, with a blank for whatever is no letter; which are letters."""
    fold, letter = np.full(_FOLD, 32, np.uint32), np.zeros(_FOLD, bool)
    for c in range(_FOLD):
        if chr(c).isalpha():
            letter[c] = True
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold, letter


class Grams:
    """n-gram buckets of texts."""

    def __init__(self):
        self.fold, self.letter = _folded()

    def codes(self, text: str) -> np.ndarray | None:
        """Folded code points with a blank at either end; None without a letter."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        near = raw < _FOLD
        low = np.where(near, raw, 32) if not near.all() else raw
        if not self.letter[low].any() and not any(map(str.isalpha, text)):
            return None
        out = self.fold[low]
        if low is not raw:
            out = np.where(near, out, raw)
        blank = np.array([32], np.uint32)
        out = np.concatenate([blank, out, blank])
        return out[np.r_[True, (out[1:] != 32) | (out[:-1] != 32)]]  # runs of blanks count as one

    def pieces(self, text: str | None) -> list[np.ndarray]:
        """Codes of a text in pieces; none without a letter. A short rest belongs to the piece before it."""
        c = self.codes(text) if text else None
        if c is None:
            return []
        n = max(1, round(len(c) / PIECE))
        return [c[len(c) * i // n : len(c) * (i + 1) // n] for i in range(n)]

    def mark(self, c: np.ndarray, row: np.ndarray) -> None:
        """Set the buckets of the n-grams of a piece."""
        h = c * np.uint32(0x9E3779B1)
        row[h >> np.uint32(32 - BITS)] = True
        for n in range(1, ORDERS):
            h = (h[:-1] ^ np.uint32(n)) * np.uint32(0x85EBCA6B) + c[n:] * np.uint32(0xC2B2AE35)
            h = h ^ (h >> np.uint32(15))
            row[(h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram bucket by language
    support: np.ndarray | None = None  # landmarks by bucket, kept for kernels
    coefficients: np.ndarray | None = None  # landmark by language


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, keep_support: bool = False) -> Model:
    """Fit on pieces of (text, language); texts without a letter are left out. Landmarks are dealt over the languages in turn."""
    grams = Grams()
    found: dict[str, list[tuple[int, bytes]]] = {}
    for text, lang in rows:
        for c in grams.pieces(text):
            found.setdefault(lang, []).append((zlib.crc32(c.tobytes()), c.tobytes()))
    marked, names = [], []
    for lang, parts in sorted(found.items()):
        for _, c in sorted(parts)[:PIECES]:
            row = np.zeros(1 << BITS, bool)
            grams.mark(np.frombuffer(c, np.uint32), row)
            marked.append(np.packbits(row))
            names.append(lang)
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    order: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        order.setdefault(name, []).append(i)
    turns = sorted((k, name) for name, at in order.items() for k in range(len(at)))[:landmarks]
    chosen = [order[name][k] for k, name in turns]
    presence = lambda at: np.unpackbits(np.stack([marked[i] for i in at]), axis=1).astype(np.float32)
    size = lambda x: np.sqrt(x.sum(1, keepdims=True))
    support = presence(chosen)
    support /= size(support)
    kernel = []
    for i in range(0, len(marked), 200):
        part = presence(range(i, min(i + 200, len(marked))))
        kernel.append((part @ support.T) / size(part))
    kernel = np.concatenate(kernel).astype(float)
    values, vectors = np.linalg.eigh(kernel[chosen])
    use = values > 1e-8 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    mapped = kernel @ root
    target = np.array([[1.0 if n == lang else -1.0 for lang in languages] for n in names])
    balance = np.array([1 / len(order[n]) for n in names])[:, None] * len(names) / len(languages)
    beta = np.linalg.solve(mapped.T @ (balance * mapped) + ridge * len(names) * np.eye(mapped.shape[1]) / 10, mapped.T @ (balance * target))
    coefficients = root @ beta
    model = Model(languages, (support.T @ coefficients).astype(np.float32))
    if keep_support:
        model.support, model.coefficients = support, coefficients
    return model


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` documents of each language whose id is not held out."""
    known = documents.where(F.col("lang").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))
    rows = class_sample(known.select("doc_id", "text", "lang"), "lang", "doc_id", per_language)
    # of rows that repeat an id one is taken, so that rows are bounded as ids are
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.*").collect()
    return fit(sorted((r["text"] or "", r["lang"]) for r in rows))


def predict(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True, least_score: float | None = None) -> DataFrame:
    """Append lang_pred and score (softmax of the regressions, 0 to 1) for whole texts.

    Null texts and texts without a letter get ``und`` and 0, as do all texts of a model without languages. Ties go to
    the language first in order. Repeated rows are predicted each; columns of the two names are replaced. With
    ``least_score`` only rows of a known language with that score or more stay.
    """

    def start():
        grams = Grams()
        weights, languages = model.weights, np.array([*model.languages, UNKNOWN], object)

        def work(texts):
            owner, length, votes = [], [], np.zeros((len(texts), max(1, len(model.languages))))
            queue: list[np.ndarray] = []

            def score_queue():
                marks = np.zeros((len(queue), 1 << BITS), bool)
                for c, row in zip(queue, marks):
                    grams.mark(c, row)
                f = (marks.astype(np.float32) @ weights) / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
                np.add.at(votes, owner[-len(queue) :], f * np.array(length[-len(queue) :])[:, None])
                queue.clear()

            for i, t in enumerate(texts):
                for c in grams.pieces(t) if len(model.languages) else ():
                    queue.append(c)
                    owner.append(i)
                    length.append(len(c))
                    if len(queue) == 64:
                        score_queue()
            if queue:
                score_queue()
            total = np.bincount(owner, length, minlength=len(texts)) if owner else np.zeros(len(texts))
            f = votes / np.maximum(total, 1)[:, None]
            e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
            known = total > 0
            names = languages[np.where(known, f.argmax(1), len(languages) - 1)].tolist()
            scores = np.where(known, (e / e.sum(1, keepdims=True)).max(1), 0.0).tolist()
            return names, scores

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    where = None if least_score is None else (lambda names, scores: [n != UNKNOWN and s >= least_score for n, s in zip(names, scores)])
    return append_columns(df, start, fields, text, keep_text, where)
