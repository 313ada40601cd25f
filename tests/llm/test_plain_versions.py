"""String kernels against loops, filters cut by ranges, and one formula at the threshold of a cosine."""

import random
import zlib

import numpy as np
import pytest

from quernel.llm import contamination, embeddings, langid, queries
from tests.compare import same_rows


def plain_codes(text):
    """Lower-case letters of the first 592 code points, other such code points as blanks, runs of blanks as one, one at either end."""
    out = [" "]
    for c in text + " ":
        low = c.lower()
        c = c if ord(c) >= 0x250 else " " if not c.isalpha() else low if len(low) == 1 else c
        if not (c == " " and out[-1] == " "):
            out.append(c)
    return out


def plain_buckets(codes):
    """Buckets of all 1- to 3-grams, each hashed by itself in whole numbers."""
    cut, found = 0xFFFFFFFF, set()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = ord(codes[i]) * 0x9E3779B1 & cut
            for k in range(1, n):
                h = ((h ^ k) * 0x85EBCA6B + ord(codes[i + k]) * 0xC2B2AE35) & cut
                h ^= h >> 15
            h = h if n == 1 else h * 0x27D4EB2F & cut
            found.add(h >> 16)
    return found


def plain_pieces(text):
    codes = plain_codes(text)
    n = max(1, round(len(codes) / langid.PIECE))
    return [codes[len(codes) * i // n : len(codes) * (i + 1) // n] for i in range(n)]


def texts(seed):
    rng = random.Random(seed)
    sounds = {"a": "the and to ing ER é 12", "b": "der die und SCH ß ä", "c": "le la de eau ç, 日本"}
    return [(" ".join(rng.choice(sounds[k].split()) + rng.choice(["", ".", "x"]) for _ in range(rng.choice([5, 40, 700]))), k) for k in "abc" for _ in range(12)]


def test_grams_are_those_of_loops():
    grams = langid.Grams()
    for text, _ in texts(1):
        for got, want in zip(grams.pieces(text), plain_pieces(text), strict=True):
            row = np.zeros(1 << langid.BITS, bool)
            grams.mark(got, row)
            assert set(np.flatnonzero(row).tolist()) == plain_buckets(want)


def test_kernel_and_regression_are_those_of_loops(spark):
    """Kernels by sets, Nyström features by an inverse root, one ridge regression a language, votes by length."""
    rows = texts(2)
    parts = {}
    for text, lang in rows:
        for p in plain_pieces(text):
            parts.setdefault(lang, []).append("".join(p))
    order = lambda p: (zlib.crc32(p.encode("utf-32-le")), p.encode("utf-32-le"))
    named = [(p, lang) for lang in sorted(parts) for p in sorted(parts[lang], key=order)]
    sets = [plain_buckets(p) for p, _ in named]
    kernel = lambda s, t: len(s & t) / np.sqrt(len(s) * len(t))
    turns = sorted((k, lang) for lang in parts for k in range(len(parts[lang])))[:9]
    own = {lang: [i for i, (_, x) in enumerate(named) if x == lang] for lang in parts}
    marks = [sets[own[lang][k]] for k, lang in turns]
    values, vectors = np.linalg.eigh(np.array([[kernel(s, t) for t in marks] for s in marks]))
    use = values > 1e-8 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    mapped = np.array([[kernel(s, t) for t in marks] for s in sets]) @ root
    weight = np.array([1 / len(own[lang]) for _, lang in named]) * len(named) / len(parts)
    languages, coefficients = sorted(parts), []
    for lang in languages:  # one against the rest
        y = np.array([1.0 if x == lang else -1.0 for _, x in named])
        left = (mapped * weight[:, None]).T @ mapped + langid.RIDGE * len(named) / 10 * np.eye(mapped.shape[1])
        coefficients.append(root @ np.linalg.solve(left, (mapped * weight[:, None]).T @ y))
    model = langid.fit(rows, landmarks=9)
    held = [t for t, _ in texts(3)] + ["The LE der", "日本 12"]
    got = langid.predict(spark.createDataFrame(list(enumerate(held)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    for text, r in zip(held, got, strict=True):
        votes = np.zeros(len(languages))
        for p in plain_pieces(text):
            near = np.array([kernel(plain_buckets(p), t) for t in marks])
            votes += len(p) * np.array([near @ c for c in coefficients])
        f = votes / sum(map(len, plain_pieces(text)))
        e = np.exp(langid.SHARPNESS * (f - f.max()))
        assert r["lang_pred"] == languages[int(f.argmax())] and r["score"] == pytest.approx(float((e / e.sum()).max()), abs=1e-4)


def test_items_of_many_shingles_take_several_filters(spark, sf_dir, monkeypatch):
    built = []
    make = contamination.bloom_filter
    monkeypatch.setattr(contamination, "FILTER_BYTES", 256)
    monkeypatch.setattr(contamination, "bloom_filter", lambda h, most: built.append(make(h, most)) or built[-1])
    same_rows(queries.op5_decontamination(spark, sf_dir), queries.oracle_sql()["op5_decontamination"], sf_dir)
    assert len(built) > 2 and all(b.nbytes <= 256 for b in built)


def test_one_formula_decides_at_the_threshold(spark, monkeypatch):
    """Pairs at exactly the threshold are linked or not whatever share of a tile's pairs is open."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        x = rng.standard_normal(16)
        x /= np.linalg.norm(x)
        w = rng.standard_normal(16)
        w -= (w @ x) * x
        w /= np.linalg.norm(w)
        rows += [(2 * k, x.tolist(), 1), (2 * k + 1, (0.93 * x + np.sqrt(1 - 0.93**2) * w).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = []
    for dense in (-1.0, 2.0):
        monkeypatch.setattr(embeddings, "DENSE", dense)
        seen.append(sorted(tuple(r) for r in embeddings.near_vectors(df).collect()))
    assert seen[0] == seen[1]
