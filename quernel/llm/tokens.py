"""Token counts by rank-synchronous array merging.

Pre-tokens that a task has not met yet are held together as ragged numpy arrays: one flat array of symbols and one of
the sequence each belongs to. In every round all sequences apply their own lowest-rank pair at once, wherever it
occurs; when no sequence has a pair left, the surviving symbols of each are counted. Counts of pre-tokens are kept in
a bounded table, so frequent words are merged once.

Applying all occurrences of a sequence's lowest pair in one round equals merging one at a time as long as no two merges
make the same symbol; the vocabulary is checked for that when it is loaded.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import append_columns

KNOWN_WORDS = 400_000  # pre-tokens whose counts a task remembers
LIMIT = 2048


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


class PairMerger:
    """Byte-pair merges of a vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len({a + b for a, b in pairs}) != len(pairs):
            raise ValueError("two merges make one symbol: rounds of simultaneous merges might differ from single merges")
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + self.suffix] for b in range(256)], np.int64)
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word."""
        if not words:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        left = sizes.copy()
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            alive = lowest < none
            if not alive.any():
                break
            # sequences without a pair are finished; the others apply theirs
            spans = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(lowest, spans)[:-1]
            hit = np.flatnonzero((rank == best) & (rank < none))
            # of a run of overlapping hits (a a a), every other one counts from the left
            run = np.r_[True, np.diff(hit) != 1]
            offset = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[offset % 2 == 0]
            left -= np.bincount(owner[hit], minlength=len(words))
            symbols[hit] = self.made[rank[hit]]
            stay = np.repeat(alive, spans)
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return left


def normalise(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # capital sigma one by one, never final
    return text.lower()


class Pretokenizer:
    """Texts to pre-tokens as UTF-8.

    Patterns do it wherever this Python's Unicode tables know all characters. Texts with characters newer than those
    are cut by the vocabulary file's own normaliser and splitter, whose tables may be newer.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.known: set[str] = set()

    def newer(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            rest = set(text) - self.known
            odd = {c for c in rest if unicodedata.category(c) == "Cn"}
            self.known |= rest - odd
            return bool(odd)

    def __call__(self, text: str) -> list[str]:
        if not self.newer(text):
            return self.words.findall(normalise(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes = {letter: b for b, letter in _byte_letters().items()}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in piece).decode("utf-8") for piece, _ in pieces]


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = LIMIT, keep_text: bool = True) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit (n_tokens > ``limit``) to every row.

    ``path`` is a .json vocabulary of word pieces whose words end in a suffix, without begin, end or added tokens;
    special strings inside a text count as one token each, as the library's default has it. Null and empty texts have
    0 bytes and 0 tokens; texts are never truncated. Repeated rows are counted each; columns of the three names that
    ``df`` has already are replaced; other columns stay.
    """

    def start():
        merger = PairMerger(path)
        special = regex.compile("|".join(map(regex.escape, merger.specials))) if merger.specials else None
        words = Pretokenizer(path)
        known: dict[str, int] = {}

        def work(texts):
            n_bytes, found, extra = [], [], []
            for t in texts:
                t = t or ""
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                extra.append(0)
                if not any(s in t for s in merger.specials):
                    found.append(words(t))
                else:
                    parts = special.split(t)
                    extra[-1] = len(parts) - 1
                    found.append([w for p in parts for w in words(p)])
            new = list(set(chain.from_iterable(found)).difference(known))
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = list(set(chain.from_iterable(found)))
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                known.update(zip(some, merger.counts([w.encode("utf-8", "surrogatepass") for w in some]).tolist()))
            n_tokens = [sum(map(known.__getitem__, f)) + e for f, e in zip(found, extra)]
            return n_bytes, n_tokens, [n > limit for n in n_tokens]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(df, start, fields, text, keep_text)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def total_tokens(counted: DataFrame) -> DataFrame:
    """One row: documents, bytes and tokens of what ``count_tokens`` returned."""
    return counted.agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"), F.sum("n_tokens").alias("tokens"))
