"""The random field by itself: expectations, bounds, and secrets that no base pattern matches."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import queries, secrets
from tests.compare import same_rows

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def some(rng, letters, k):
    return "".join(rng.choice(letters) for _ in range(k))


#: Secrets that no base pattern matches; none is of a form that a fit invents with this prefix or trigger.
PLANTED = [
    lambda r: f'pwd = "{some(r, LETTERS, 12)}"',
    lambda r: "pwd = CorrectHorseBattery",
    lambda r: f"Authorization: Bearer {some(r, LETTERS + '-_', 36)}",
    lambda r: f"ghp_{some(r, LETTERS, 36)}",
    lambda r: f"sk_live_{some(r, LETTERS, 24)}",
    lambda r: f"DB_KEY={some(r, LETTERS + '+/', 40)}",
    lambda r: f"credential => '{some(r, LETTERS, 20)}'",
    lambda r: f"xoxb-{some(r, '0123456789', 11)}-{some(r, LETTERS, 24)}",
    lambda r: f"eyJ{some(r, LETTERS, 30)}.{some(r, LETTERS, 40)}.{some(r, LETTERS + '_-', 43)}",
]
HARMLESS = ["4111 1111 1111 1111", "1234567890123456", "jane.doe42@mail3.example.com", "+49 170 5551234", "2024-03-05", "version 12.34.5", "https://www.example.org/a/b?x=12", "192.168.10.3", "the token ring", "the password is required", "HTTPServerError", "MAX_VALUE", "isbn 978-3-16-148410-0", "ORD-2024-00123"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0).where("text is not null")
    model = secrets.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 1))
    return model, [r["text"] for r in held.orderBy("doc_id").select("text").collect()]


def test_expectations_agree_with_enumeration():
    rng = np.random.default_rng(5)
    moves, starts = rng.normal(size=(3, 3)), rng.normal(size=3)
    moves[secrets.OUTSIDE, secrets.INSIDE] = starts[secrets.INSIDE] = secrets.CLOSED
    lengths = np.array([5, 4, 4, 2, 1])
    emit = rng.normal(size=(5, 5, 3)) * 3
    total, share, pairs = secrets._expectations(emit, lengths, moves, starts)
    want_total, want_share, want_pairs = 0.0, np.zeros_like(share), np.zeros((3, 3))
    for s, n in enumerate(lengths):
        paths = list(product(range(3), repeat=int(n)))
        value = np.array([starts[p[0]] + sum(emit[s, t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        top = value.max()
        z = np.exp(value - top).sum()
        want_total += top + np.log(z)
        for p, w in zip(paths, np.exp(value - top) / z):
            for t, k in enumerate(p):
                want_share[s, t, k] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert total == pytest.approx(want_total)
    assert np.allclose(share, want_share) and np.allclose(pairs, want_pairs)


def test_bounded_lines_are_outside_on_their_best_path(corpus):
    """Every line decoded gives the same spans as only those that the bounds leave."""
    model, texts = corpus
    rng = random.Random(8)
    tagger = secrets.Tagger(model)
    texts = [t + "\n" + rng.choice(PLANTED)(rng) + " " + rng.choice(HARMLESS) if i % 2 else t for i, t in enumerate(texts[:150])]
    for t in texts:
        got, want, at = tagger.spans(t), [], 0
        weights = [w for f in secrets.file_features(t) if (w := model.emissions.get(f))]
        of_file = [sum(x) for x in zip([0.0] * 3, *weights)]
        for line in t.split("\n"):
            places = [m.span() for m in secrets._TOKEN.finditer(line)]
            words = [line[a:b] for a, b in places]
            names = [secrets.word(w) for w in words]
            if places:
                for (a, b), tag in zip(places, secrets.viterbi([tagger.emission(i, words, names, of_file) for i in range(len(words))], model)):
                    if tag == secrets.BEGIN:
                        want.append(("crf", at + a, at + b))
                    elif tag == secrets.INSIDE:
                        want[-1] = ("crf", want[-1][1], at + b)
            at += len(line) + 1
        assert got == want


def test_secrets_that_no_pattern_matches(corpus):
    """Planted in held-out documents: found by the field alone. Harmless look-alikes and the documents themselves stay clean."""
    model, texts = corpus
    tagger, rng = secrets.Tagger(model), random.Random(77)
    clean = [t for t in texts if not secrets.base_spans(t) and len(t) > 40]
    false = sum(bool(tagger.spans(t)) for t in clean)
    assert false <= len(clean) * 0.005
    clean = clean[:40]
    found = tried = 0
    for make in [*PLANTED, *[lambda r, h=h: h for h in HARMLESS]]:
        harmless = len(make(rng)) and make(rng) in HARMLESS
        for t in clean:
            words = t.split(" ")
            at, s = rng.randint(0, len(words)), make(rng)
            assert not secrets.base_spans(s)
            front = " ".join(words[:at] + [""])
            whole = front + " ".join([s, *words[at:]])
            hit = any(a < len(front) + len(s) and b > len(front) for _, a, b in tagger.spans(whole))
            if harmless:
                false += hit
            else:
                found, tried = found + hit, tried + 1
    assert found >= 0.95 * tried
    assert false <= 0.02 * len(clean) * len(HARMLESS)


def test_programs_hold_few_secrets(corpus):
    """Files of the standard library, of which no fit has seen one: most stay clean."""
    import glob
    import os

    tagger = secrets.Tagger(corpus[0])
    files = sorted(f for f in glob.glob(os.path.dirname(os.__file__) + "/*.py"))[::3]
    texts = [open(f, encoding="utf-8", errors="replace").read() for f in files]
    marked = [bool(secrets.without(tagger.spans(t), secrets.base_spans(t), t)) for t in texts]
    assert len(files) > 40 and sum(marked) <= 0.25 * len(files)


def test_what_base_spans_cover_is_cut_off():
    text = 'x = "gg' + "0" * 32 + 'zz" y'
    base = secrets.base_spans(text)
    assert base == [("hex", 7, 39)]
    assert secrets.without([("crf", 5, 41)], base, text) == [("crf", 5, 7), ("crf", 39, 41)]
    _, a, b = base[0]
    assert secrets.without([("crf", a, b)], base, text) == [] and secrets.without([("crf", 0, 1)], [], "x") == [("crf", 0, 1)]
    assert secrets.without([("crf", 0, 5)], [], ' "a" ') == [("crf", 2, 3)]


def test_masked_lines_hide_what_the_patterns_match():
    rows = secrets.training_lines(['call me, token = "' + "0123456789abcdef" * 2 + '" now'] * 3 + ["some plain words of no interest here"] * 3)
    masked = [tokens for tokens, tags, _ in rows if "token" not in tokens and secrets.BEGIN in tags]
    assert masked and all(len(tokens) == len(tags) for tokens, tags, _ in rows)
    long = secrets.training_lines(["a1b2c3d4e5 " * 1000])
    assert sum(len(tokens) for tokens, _, _ in long) == 1000 and max(len(tokens) for tokens, _, _ in long) <= secrets.PIECE


def test_a_corpus_without_secrets_still_gives_a_field():
    model = secrets.fit([f"line {i} of plain words and nothing else" for i in range(60)])
    assert secrets.Tagger(secrets.fit([])).spans("pwd = hunter2hunter2") == []
    assert secrets.Tagger(model).spans("line 3 of plain words") == []


def test_base_columns_agree_with_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    same_rows(queries.op9_secret_scan(spark, sf_dir).drop("spans"), queries.oracle_sql()["secret_base_spans"], sf_dir)
