"""Small tables with what operators must stand: nulls, empty and very long texts, ties, repeats, clashing columns."""

WORDS = "the of and to in is that for it as with was his on be at by had not are but from or have an they which one you were all her she there would their".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", ","]) for _ in range(n)) + "."


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def odd_rows():
    long = prose(1, 30_000)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t", "en", "a", 5),
        (4, "!!! 123", "en", "a", 7),
        (5, long, "en", "a", len(long)),
        (6, prose(2, 80), "en", "b", 1),
        (7, prose(2, 80), "en", "b", 1),
        (7, prose(2, 80), "en", "b", 1),
        (None, prose(3, 50), "en", "b", 1),
        (8, "Σίσυφος ΑΣ <|endoftext|> don't I'LL naïve 日本語 \U0001f600\U0001f600 '''s", "el", None, 1),
        (9, "a\x00b\x1cc\x85d\x0bé", None, "c", 1),
    ]
