"""Secret scans: base patterns and a linear-chain conditional random field.

Three base patterns give certain spans. A CRF tags every token of a line as begin, inside or outside of a secret, from
the token's shape, the neighbouring words and features of the file, and is decoded by Viterbi over the whole line. Its
spans are added to the base ones; what a base span covers already is cut off them.

The patterns alone can only teach the CRF what they match themselves. So it is trained on three kinds of lines of a
sample: lines as they are, tagged by their base spans; copies of them in which the trigger word is masked by another
one and the value is replaced by an invented one; and ordinary lines with an invented secret, or something that only
looks like one (numbers, addresses, paths, identifiers), planted in them.

A line is decoded only if some token of it can be tagged as secret at all: the best emission that a token can have in
its text is bounded by its own shape and the most telling words of that text, and a line whose tokens all stay under
the bound is outside as a whole on its best path (see ``Tagger``). No token is left out for its length or letters.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import ne

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import append_columns
from quernel.plans.storage import materialize

KINDS = ("assign", "access", "hex", "crf")
SAMPLE = 3000  # about as many documents as a fit looks at, half of them with a base span
LINES = 1200  # lines of a kind (with a base span, with an unusual token, plain) that a fit takes of them, by a hash
PIECE = 128  # tokens of a training line that are tagged together; longer lines are several pieces, none is dropped
LEAST_SEEN = 3  # occurrences of a neighbouring word from which it is a feature
LEAST_WEIGHT = 0.1  # features whose weights are all under it are left out of a model
KNOWN_TOKENS = 300_000
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Texts with a base span, for the JVM.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
_HEX_BYTES = bytes(1 if 48 <= b <= 57 or 97 <= b <= 102 else 0 for b in range(256))
_HEX_RUN = b"\1" * 8
_NO_HEX = str.maketrans("", "", "0123456789abcdefABCDEF")
_TOKEN = re.compile(r"[\w+/-]+|[^\s\w+/-]")
OUTSIDE, BEGIN, INSIDE = range(3)
CLOSED = -1e4  # score of what cannot be: inside after outside


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS; leftmost non-overlapping matches of each kind.

    An assign span is the whole match; its value has 8 characters or more. The checks before each pattern only pass
    by texts that cannot match: no ``:`` or ``=``, no AKIA, no eight hex digits at distances of four.
    """
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass")[::4].translate(_HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- features -------------------------------------------------------------------------------------------------------


def shape(token: str) -> list[str]:
    """Features of a token by itself."""
    n = len(token)
    if n < 4:
        return ["short", "t=" + token.lower()]
    ascii_ = token.isascii()
    various = min(len(set(token)) // 2, 12)
    vowels = 10 * sum(map(token.count, "aeiouyAEIOUY")) // n
    if token.isalpha() and token.islower():
        kinds, digits, marks, turns = "l", 0, 0, 0
    else:
        digits = sum(map(str.isdigit, token))
        upper = sum(map(str.isupper, token))
        marks = n - sum(map(str.isalnum, token))
        kinds = "".join(f for f, x in (("l", n - digits - marks > upper), ("u", upper), ("d", digits), ("m", marks)) if x)
        kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "m" for c in token]
        turns = min(10 * sum(map(ne, kind, kind[1:])) // n, 9)
    out = [f"n{min(n // 4, 12)}", f"k={kinds}", f"k={kinds}n{min(n // 8, 4)}", f"s{various}", f"s{various}n{min(n // 8, 4)}", f"x{turns}k{len(kinds)}", f"d{5 * digits // n}", f"v{vowels}"]
    if not ascii_:
        out.append("wide")
    if kinds == "d":
        out.append("number")
    elif kinds in ("l", "u") or kinds == "lu" and token[1:].islower():
        out.append("word" if n < 16 else "longword")
    if digits and ascii_ and not token.translate(_NO_HEX):
        out.append("hex")
    if marks:
        parts = [p for p in re.split(r"[^A-Za-z0-9]+", token) if p]
        out.append("wordparts" if all(p.isalpha() and (p.islower() or p.isupper()) or p.isdigit() for p in parts) else "oddparts")
    return out


def word(token: str) -> str:
    """A token as others see it beside them: small words and marks by themselves, the rest by their kind."""
    if token.isalpha() or len(token) == 1:
        return token.lower() if len(token) <= 12 else "~"
    return "0" if any(map(str.isdigit, token)) else token.lower() if len(token) <= 12 else "~"


def file_features(text: str) -> list[str]:
    lines = text.count("\n") + 1
    return [f"f:lines{min(lines.bit_length(), 6)}", f"f:pairs{min(4, 8 * text.count('=') // lines)}"]


#: Places of the neighbours whose words count, by the prefix of their features.
_BESIDE = (("-1:", -1), ("-2:", -2), ("-3:", -3), ("+1:", 1))


@dataclass
class Model:
    emissions: dict[str, list[float]]  # by feature: weights of the three tags
    moves: list[list[float]]
    starts: list[float]


# --- training lines -------------------------------------------------------------------------------------------------

# Words that announce a value, and how they are joined to it.
ALIASES = "pwd pass passphrase credential credentials auth authorization bearer access_key secret_key private_key client_secret session cookie signing_key webhook pin login db_pass key".split()
JOINS = (" = ", "=", ": ", ":", " := ", " => ", " is ", ' = "', "='", ': "', " ")
_HEXES, _LETTERS = "0123456789abcdef", string.ascii_letters + string.digits


def invent(rng: random.Random) -> str:
    """A value that no one could guess."""
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    kind = rng.randrange(8)
    if kind == 0:
        return some(_HEXES, 20, 31)
    if kind == 1:
        return some(_HEXES.upper(), 24, 48)
    if kind == 2:
        return some(_LETTERS, 14, 44)
    if kind == 3:
        return some(_LETTERS + "+/", 24, 64)
    if kind == 4:
        return some(string.ascii_lowercase + string.digits, 14, 40)
    if kind == 5:
        return some(string.ascii_lowercase, 2, 5) + rng.choice("_-") + some(_LETTERS, 18, 40)
    if kind == 6:
        return ".".join(some(_LETTERS + "_-", 16, 40) for _ in range(3))
    return some(_LETTERS + "_-", 20, 40)


def phrase(rng: random.Random) -> str:
    """A password that someone remembers; a secret only where a word announces it."""
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    syllables = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(2, 3))]
    if rng.random() < 0.5:
        return "".join(s.capitalize() for s in syllables) + rng.choice(["", str(rng.randint(1, 9999))])
    return some(string.ascii_letters, 3, 8) + rng.choice(["", "-", "_", "!"]) + some(string.digits, 2, 5) + some(string.ascii_letters, 1, 5)


def harmless(rng: random.Random, words: list[str]) -> str:
    """What may look like a secret to a careless eye and is none."""
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    name = lambda: rng.choice(words).lower()
    kind = rng.randrange(12)
    if kind == 0:
        return some(string.digits, 8, 20)
    if kind == 1:
        return f"{name()}{rng.randint(1, 99)}@{name()}.example.com"
    if kind == 2:
        return f"https://{name()}.example.org/{name()}/{name()}?id={rng.randint(1, 10**6)}"
    if kind == 3:
        return f"/usr/{name()}/{name()}-{rng.randint(1, 9)}.{rng.randint(1, 20)}/{name()}"
    if kind == 4:
        return "".join(name().capitalize() for _ in range(rng.randint(2, 4)))
    if kind == 5:
        return "_".join(name() for _ in range(rng.randint(2, 4))).upper()
    if kind == 6:
        return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}"
    if kind == 7:
        return "-".join(some(_HEXES, n, n) for n in (8, 4, 4, 4, 12))
    if kind == 8:
        return f"+{some(string.digits, 2, 3)}-{some(string.digits, 3, 4)}-{some(string.digits, 4, 8)}"
    if kind == 9:
        return "_".join(name() for _ in range(rng.randint(2, 4)))
    if kind == 10:
        return f"{rng.choice(ALIASES)}{rng.choice(JOINS)}{name()}"
    return f"{name()}{rng.randint(1, 999)}"


def code(rng: random.Random, words: list[str]) -> str:
    """A line of a program or of markup, in which no one has put a secret."""
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    base = lambda: rng.choice(words).lower() if rng.random() < 0.7 else "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    short = lambda: rng.choice(["x", "i", "fp", "ctx", "buf", "tmp", "n2", "utf8", "sha256", "int32", "x509", "md5", "b64", "ipv6", "py3k"])
    snake = lambda: rng.choice(["", "", "", "_", "__"]) + "_".join(base() if rng.random() < 0.85 else short() for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", "", "2", "_1", "64"])
    camel = lambda: "".join(rng.choice([base().capitalize(), base().capitalize(), base().capitalize(), rng.choice(["HTTP", "URL", "BZ2", "IPv4", "UTF8", "XML", "SSL", "ID", "2D"])]) for _ in range(rng.randint(1, 4)))
    mixed = lambda: (lambda c: c[0].lower() + c[1:])(camel())
    upper = lambda: "_".join(base().upper() if rng.random() < 0.9 else some(string.digits, 1, 3) for _ in range(rng.randint(1, 5)))
    number = lambda: rng.choice([some(string.digits, 1, 4), "0x" + some(_HEXES, 2, 16), "0X" + some(_HEXES.upper(), 2, 8), f"{some(string.digits, 1, 3)}.{some(string.digits, 1, 12)}", f"1e-{some(string.digits, 1, 2)}", f"{some(string.digits, 1, 3)}_{some(string.digits, 3, 3)}", some(string.digits, 8, 20), f"{some(string.digits, 5, 9)}L"])
    any_name = lambda: rng.choice([snake, snake, snake, camel, mixed, upper])()
    chain = lambda: ".".join(any_name() for _ in range(rng.randint(1, 4)))
    call = lambda: f"{chain()}({', '.join(rng.choice([any_name, number, chain, lambda: repr(base()), lambda: any_name() + '=' + number()])() for _ in range(rng.randint(0, 4)))})"
    escapes = ("\\U0001", "\\U000", "\\u", "\\x", "&#x", "%")
    told = lambda: " ".join(base() for _ in range(rng.randint(2, 7)))
    announced = lambda: rng.choice(ALIASES + ["password", "token", "secret", "api_key", "tok", "keys", "passwords", "tokens"])
    forms = (
        lambda: f"from {chain()} import {any_name()}, {any_name()}",
        lambda: f"import {chain()} as {snake()}",
        lambda: f"def {snake()}(self, {snake()}={number()}, *{snake()}, {announced()}=None):",
        lambda: f"class {camel()}({chain()}):",
        lambda: f"{any_name()} = {call()}",
        lambda: f"self.{any_name()} = {any_name()} | {upper()} & {number()}",
        lambda: f"raise {camel()}Error('{told()}' % {call()})",
        lambda: f"if {chain()} is not None and {call()} != {number()}:",
        lambda: ", ".join(rng.choice(["'{}'", '"{}"', "{}"]).format(any_name()) for _ in range(rng.randint(1, 6))) + ",",
        lambda: f"{upper()} = {number()}",
        lambda: f"return {{'{any_name()}': {call()}, \"{any_name()}\": {number()}}}",
        lambda: f'<{base()} class="{base()}-{base()} {mixed()}" id="{mixed()}{number()}">{told()}</{base()}>',
        lambda: f"# {told()} (https://{base()}.example.org/{base()}/{upper()}-{some(string.digits, 3, 4)}/{camel()}#{any_name()})",
        lambda: f"    {announced()} = {call()}",
        lambda: f"for {announced()}, {any_name()} in {chain()}.items():",
        lambda: f"    {announced()}: {rng.choice(['str', 'int', 'Optional[str]', 'bytes', chain()])} = {rng.choice(['None', call(), any_name()])}",
        lambda: f"{chain()}[{rng.choice(['', repr(announced())])}{number()}:{any_name()}] += {call()}",
        lambda: f"@{chain()}\t# {told()}",
        lambda: f"    {number()}, {number()}, {number()},{' ' * rng.randint(1, 3)}#  {number()} -> {told().upper()}",
        lambda: f"    '{rng.choice(escapes)}{some(_HEXES, 2, 5)}{rng.choice(['', base()])}' : {number()},  # {told()}",
        lambda: " ".join(f"{rng.choice(escapes)}{some(_HEXES, 2, 4)}" for _ in range(rng.randint(1, 6))).replace(" ", rng.choice(["", "", base()])),
        lambda: f"    0x{some(_HEXES, 2, 2)}: 0x{some(_HEXES, 4, 4)},{' ' * rng.randint(1, 3)}#  0x{some(_HEXES.upper(), 2, 2)} -> {told().upper()}",
        lambda: f"    '{told()}'{' ' * rng.randint(1, 3)}#  0x{some(_HEXES.upper(), 2, 4)} -> {told().upper()}",
        lambda: f"'{some(string.digits, 2, 2)}-{base().capitalize()[:3]}-{some(string.digits, 4, 4)}', '{base().capitalize()}_{base().capitalize()}_{some(string.digits, 4, 4)}', '{rng.choice(['', '-'])}0X{some(_HEXES, 1, 2)}p-{some(string.digits, 3, 4)}'",
        lambda: f"xmlns:{base()}='http://www.{base()}.org/{some(string.digits, 4, 4)}/{camel()}/{base()}-{camel()}.{base()}'",
        lambda: f"{camel()}{camel()}{camel()}({camel()}{camel()}, {camel()}{camel()}):",
        lambda: f"{any_name()}('{{{'-'.join(some(_HEXES, k, k) for k in (8, 4, 4, 4, 12))}}}', {call()})",
        lambda: " = ".join(f"{letter}{k}" for letter in rng.choice(string.ascii_lowercase) for k in range(rng.randint(1, 600), 600, 61)),
        lambda: f"{any_name()}({':'.join(some(_HEXES, 2, 4) for _ in range(rng.randint(4, 8)))!r}, '{some(string.digits, 1, 3)}.{some(string.digits, 1, 3)}.{some(string.digits, 1, 3)}.1', -0x1.{some(_HEXES, 1, 6)}p-{some(string.digits, 2, 4)})",
        lambda: f"# {rng.choice(['commit', 'rev', 'changeset', 'bpo', 'id'])} {some(_HEXES, 7, 12)}: {told()}",
        lambda: f">>> {call()}",
        lambda: f"'{told()}' {rng.choice(['%s', '{0}', '{!r}'])} \\x{some(_HEXES, 2, 2)}\\x{some(_HEXES, 2, 2)}\\n",
        lambda: f"{any_name()}->{any_name()}({any_name()}::{any_name()}, &{any_name()}); // {told()}",
        lambda: f"{announced()}={any_name()}, {announced()}={call()}" if rng.random() < 0.5 else f"{any_name()}.{announced()}({any_name()}, {announced()})",
        lambda: f"    r'[{some(string.ascii_letters, 1, 3)}-{some(string.ascii_letters, 1, 1)}]+(?P<{base()}>\\d{{{some(string.digits, 1, 1)},}})|{any_name()}$'",
        lambda: f"{' ' * rng.randint(0, 12)}{rng.choice(['pass', 'try:', 'else:', 'return', 'break', 'yield'])} {rng.choice(['', any_name(), call()])}",
    )
    return " " * (4 * rng.randint(0, 3)) + rng.choice(forms)()


def code_files(words: list[str], lines: int) -> list[str]:
    """Texts of about ``lines`` lines of ``code`` in all."""
    rng = random.Random(len(words))
    return ["\n".join(code(rng, words) for _ in range(n)) for n in (lines // 2, *[40] * (lines // 80), *[5] * (lines // 40))]


def tagged_tokens(line: str, secrets: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens of a line and their tags by the places of its secrets."""
    tokens, tags, last = [], [], None
    for m in _TOKEN.finditer(line):
        own = next((s for s in secrets if m.start() < s[1] and m.end() > s[0]), None)
        tokens.append(m[0])
        tags.append(OUTSIDE if own is None else INSIDE if own == last else BEGIN)
        last = own
    return tokens, tags


def _values(text: str) -> list[tuple[int, int, int]]:
    """(begin of the span, begin of the secret, end) by the base spans: of an assignment only the value is the secret."""
    return [(a, _ASSIGN.match(text, a).start(2) if kind == "assign" else a, b) for kind, a, b in base_spans(text)]


def _kinds(texts: list[str]) -> list[list[tuple[int, str, list, list[str]]]]:
    """(crc, line, base spans, features of the file) of lines with a base span, with an unusual token, and of the others."""
    kinds: list[list[tuple[int, str, list, list[str]]]] = [[], [], []]
    for text in filter(None, texts):
        found, of_file, at = _values(text), file_features(text), 0
        for line in text.split("\n"):
            own = [(s - at, v - at, min(e - at, len(line))) for s, v, e in found if s >= at and s < at + len(line)]
            odd = any(len(t) >= 8 and (any(c.isdigit() for c in t) or any(c.isupper() for c in t[1:])) for t in _TOKEN.findall(line))
            if line.strip():
                kinds[0 if own else 1 if odd else 2].append((zlib.crc32(line.encode("utf-8", "surrogatepass")), line, own, of_file))
            at += len(line) + 1
    return kinds


class _Rows(list):
    """(tokens, tags, features of the file) of lines, in pieces."""

    def add(self, line: str, secrets: list[tuple[int, int]], of_file: list[str]) -> None:
        tokens, tags = tagged_tokens(line, secrets)
        for i in range(0, len(tokens), PIECE):
            self.append((tokens[i : i + PIECE], tags[i : i + PIECE], of_file))

    def plant(self, rng: random.Random, line: str, of_file: list[str], value: str, before: str, secret: bool) -> None:
        at = next((m.start() for m in re.finditer(r"(?<=\s)\S", line) if m.start() >= rng.randint(0, len(line))), 0)
        head = line[:at] + before
        after = '"' if before.endswith('"') else "'" if before.endswith("'") else ""
        self.add(f"{head}{value}{after} {line[at:]}", [(len(head), len(head) + len(value))] if secret else [], of_file)


def program_lines(texts: list[str], lines: int = LINES) -> list[tuple[list[str], list[int], list[str]]]:
    """(tokens, tags, features of the file) of about ``lines`` invented lines of programs, named after words of ``texts``; some have a secret."""
    names = sorted({t for _, line, _, _ in sorted(_kinds(texts)[2], key=lambda x: x[:2])[:lines] for t in _TOKEN.findall(line) if 2 < len(t) < 12 and t.isalpha() and t.isascii()}) or ["word"]
    out = _Rows()
    for text in code_files(names, lines):
        of_file = file_features(text)
        for line in text.split("\n"):
            rng = random.Random(zlib.crc32(line.encode("utf-8")))
            out.add(line, [], of_file)
            if rng.random() < 0.15:
                out.plant(rng, line, of_file, invent(rng), rng.choice(ALIASES + ["password", "token"]) + rng.choice(JOINS[:4] + JOINS[7:10]), True)
    return list(out)


def training_lines(texts: list[str], lines: int = LINES) -> list[tuple[list[str], list[int], list[str]]]:
    """(tokens, tags, features of the file) of lines of ``texts``, as they are, masked and planted, in pieces.

    Of the lines with a base span, with an unusual token (a digit or capital inside 8 letters or more), and of the
    others about ``lines`` each are taken, by a hash. All choices follow from hashes of the lines.
    """
    out = _Rows()
    for k, group in enumerate(_kinds(texts)):
        for crc, line, own, of_file in sorted(group, key=lambda x: x[:2])[:lines]:
            rng = random.Random(crc)
            out.add(line, [(v, e) for _, v, e in own], of_file)
            if k == 0:
                for _ in range(2):  # masked: another word in front, another value
                    text, at, places = "", 0, []
                    for s, v, e in own:
                        if s < at:
                            continue
                        front = re.sub(r"[A-Za-z_]+", lambda m: rng.choice(ALIASES), line[s:v], count=1)  # noqa: B023
                        value = invent(rng) if v == s or rng.random() < 0.7 else phrase(rng)
                        text += line[at:s] + front
                        places.append((len(text), len(text) + len(value)))
                        text, at = text + value, e
                    out.add(text + line[at:], places, of_file)
            elif k == 2:
                words = [w for w in _TOKEN.findall(line) if len(w) > 1 and w.isalpha()] or ["word"]
                before = rng.choice(ALIASES + ["password", "token", "secret", "api_key"]) + rng.choice(JOINS)
                for kind, share in enumerate((0.35, 0.35, 0.7, 0.35)):
                    if rng.random() < share:
                        if kind == 0:
                            out.plant(rng, line, of_file, invent(rng), before, True)
                        elif kind == 1:
                            out.plant(rng, line, of_file, invent(rng), "", True)
                        elif kind == 2 and before.strip()[-1] in "=:>\"'":
                            out.plant(rng, line, of_file, phrase(rng), before, True)
                        else:
                            out.plant(rng, line, of_file, harmless(rng, words), "", False)
    return list(out)


# --- fitting --------------------------------------------------------------------------------------------------------


def _expectations(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log partition sum, tag probabilities, expected moves) of sequences sorted by falling length, by scaled forward-backward.

    ``emit`` is (sequence, place, tag); rows past a sequence's length are not read and have probability 0.
    """
    n, longest, _ = emit.shape
    top = emit.max(2, keepdims=True)
    e, a = np.exp(emit - top), np.exp(moves)
    alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((n, longest))
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest + 1)]  # sequences longer than t
    alpha[:, 0] = np.exp(starts) * e[:, 0]
    for t in range(longest):
        m = live[t]
        if t:
            alpha[:m, t] = (alpha[:m, t - 1] @ a) * e[:m, t]
        scale[:m, t] = alpha[:m, t].sum(1)
        alpha[:m, t] /= scale[:m, t, None]
    pairs = np.zeros((3, 3))
    for t in range(longest - 1, 0, -1):
        m = live[t]
        back = e[:m, t] * beta[:m, t] / scale[:m, t, None]
        pairs += (alpha[:m, t - 1].T @ back) * a
        beta[:m, t - 1] = back @ a.T
    real = np.arange(longest) < lengths[:, None]
    total = float((np.log(scale) * real).sum() + (top[..., 0] * real).sum())
    return total, alpha * beta * real[..., None], pairs


def fit_lines(rows: list[tuple[list[str], list[int], list[str]]], epochs: int = 60, rate: float = 0.25, decay: float = 2e-5) -> Model:
    """Maximum likelihood by Adam over (tokens, tags, features of the file), with forward-backward."""
    rows = sorted((r for r in rows if r[0]), key=lambda r: -len(r[0]))
    if not any(t != OUTSIDE for _, tags, _ in rows for t in tags):
        return Model({}, [[0.0, CLOSED, CLOSED]] * 3, [0.0, CLOSED, CLOSED])  # nothing to learn from: all is outside
    types: dict[str, int] = {}
    words: dict[str, int] = {"edge": 0}
    token, beside = [], [[] for _ in _BESIDE]
    files: dict[str, int] = {}
    of_file = [[], []]
    for tokens, _, features in rows:
        ids = [types.setdefault(t, len(types)) for t in tokens]
        near = [words.setdefault(word(t), len(words)) for t in tokens]
        token += ids
        for column, (_, step) in zip(beside, _BESIDE):
            column += [near[i + step] if 0 <= i + step < len(near) else 0 for i in range(len(near))]
        for column, f in zip(of_file, features):
            column += [files.setdefault(f, len(files))] * len(ids)
    own: dict[str, int] = {}
    parts = [(i, own.setdefault(f, len(own))) for t, i in types.items() for f in [*shape(t), "any"]]
    part_type, part = np.array(parts).T
    # one table of weights: own features, words by place, features of the file
    seen = np.bincount(np.concatenate(beside), minlength=len(words)) >= LEAST_SEEN * len(_BESIDE)
    seen[0] = True
    size = len(words)
    indexed = [np.array(c) + len(own) + k * size for k, c in enumerate([*beside])] + [np.array(c) + len(own) + len(_BESIDE) * size for c in of_file]
    names = list(own) + [p + w for p, _ in _BESIDE for w in words] + list(files)
    open_ = np.concatenate([np.ones(len(own), bool), np.tile(seen, len(_BESIDE)), np.ones(len(files), bool)])
    token, lengths = np.array(token), np.array([len(r[0]) for r in rows])
    tag = np.concatenate([np.array(r[1]) for r in rows])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = len(token)
    # sequences of about one length are held in one array
    cuts = [0, *np.flatnonzero(np.diff(np.floor(np.log2(lengths)))) + 1, len(rows)]
    blocks = [(lengths[a:b], first[a:b, None] + np.arange(lengths[a]), np.arange(lengths[a]) < lengths[a:b, None]) for a, b in zip(cuts, cuts[1:])]
    weights, moves, starts = np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3)
    moves[OUTSIDE, INSIDE] = starts[INSIDE] = CLOSED
    gold = np.eye(3)[tag]
    same = np.ones(n, bool)
    same[first] = False
    at = np.flatnonzero(same)
    gold_moves = np.bincount(3 * tag[at - 1] + tag[at], minlength=9).reshape(3, 3)
    gold_starts = gold[first].sum(0)
    gather = lambda w: np.stack([np.bincount(part_type, w[part, k], minlength=len(types)) for k in range(3)], 1)[token] + sum(w[i] for i in indexed)
    m, v = ([np.zeros_like(x) for x in (weights, moves, starts)] for _ in range(2))
    for epoch in range(1, epochs + 1):
        emit = gather(weights)
        share, pairs, begins = np.zeros((n, 3)), np.zeros((3, 3)), np.zeros(3)
        for length, place, real in blocks:
            _, p, x = _expectations(emit[np.where(real, place, 0)], length, moves, starts)
            share[place[real]] = p[real]
            pairs += x
            begins += p[:, 0].sum(0)
        apart = share - gold
        by_type = np.stack([np.bincount(token, apart[:, k], minlength=len(types)) for k in range(3)], 1)
        slope = np.zeros_like(weights)
        for k in range(3):
            slope[: len(own), k] = np.bincount(part, by_type[part_type, k], minlength=len(own))
            for i in indexed:
                slope[:, k] += np.bincount(i, apart[:, k], minlength=len(names))
        slopes = [np.where(open_[:, None], slope / len(rows) + decay * weights, 0), (pairs - gold_moves) / len(rows), (begins - gold_starts) / len(rows)]
        for k, x in enumerate((weights, moves, starts)):
            m[k] = 0.9 * m[k] + 0.1 * slopes[k]
            v[k] = 0.99 * v[k] + 0.01 * slopes[k] ** 2
            x -= rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-6)
        moves[OUTSIDE, INSIDE] = starts[INSIDE] = CLOSED
    told = np.abs(weights).max(1) >= LEAST_WEIGHT
    return Model({f: weights[i].tolist() for i, f in enumerate(names) if told[i]}, moves.tolist(), starts.tolist())


def fit(texts: list[str], lines: int = LINES) -> Model:
    return fit_lines(training_lines(texts, lines) + program_lines(texts, lines))


# --- decoding -------------------------------------------------------------------------------------------------------


def viterbi(emissions: list[list[float]], model: Model) -> list[int]:
    """The likeliest tags; ties go to the tag first in order."""
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = model.moves
    o, b, i = (s + e for s, e in zip(model.starts, emissions[0]))
    back = []
    for eo, eb, ei in emissions[1:]:
        to = [(o + oo, b + bo, i + io), (o + ob, b + bb, i + ib), (o + oi, b + bi, i + ii)]
        best = [max(x) for x in to]
        back.append([x.index(y) for x, y in zip(to, best)])
        o, b, i = best[0] + eo, best[1] + eb, best[2] + ei
    last = (o, b, i)
    tags = [last.index(max(last))]
    for came in reversed(back):
        tags.append(came[tags[-1]])
    return tags[::-1]


class Tagger:
    """Spans of the CRF in texts.

    On a path with secret tokens, a run of k of them can be made outside: the path loses the k tokens' emissions over
    those of outside and at most k + 1 moves over that from outside to outside. If every token's gain over outside is
    under -2 times the best move's gain, no run pays, and the line is outside as a whole. A token's gain is at most
    that of its shape and file plus, for each neighbouring place, that of the most telling word of the text.
    """

    def __init__(self, model: Model):
        self.model = model
        none = [0.0, 0.0, 0.0]
        self.beside = [{f[len(p) :]: w for f, w in model.emissions.items() if f.startswith(p)} for p, _ in _BESIDE]
        self.edge = [d.get("edge", none) for d in self.beside]
        stay = model.moves[OUTSIDE][OUTSIDE]
        moves = [x - stay for a, row in enumerate(model.moves) for b, x in enumerate(row) if (a, b) != (OUTSIDE, OUTSIDE)]
        self.least = -2 * max(0.0, *moves, *(s - model.starts[OUTSIDE] for s in model.starts[1:]))
        self.edge_gain = [self.over(e) for e in self.edge]
        every = {name for d in self.beside for name in d}
        gains = {name: [self.over(d[name]) if name in d else 0.0 for d in self.beside] for name in every}
        self.heard = {name: g for name, g in gains.items() if max(g) > 0}
        self.own: dict[str, list[float]] = {}
        self.gain: dict[str, float] = {}
        self.telling: dict[str, list[float]] = {}
        self.plain: dict[tuple, tuple[list[float], float]] = {}  # by what the shape of a lower-case word depends on

    @staticmethod
    def over(w: list[float]) -> float:
        return max(w[BEGIN], w[INSIDE]) - w[OUTSIDE]

    def learn(self, token: str) -> None:
        n = len(token)
        if n >= 4 and token.isalpha() and token.islower():
            key = (n, len(set(token)) // 2, 10 * sum(map(token.count, "aeiouy")) // n, token.isascii())
            found = self.plain.get(key)
            if found is None:
                found = self.plain[key] = self.weigh(token)
            own, gain = found
            name = token if n <= 12 else "~"
        else:
            own, gain = self.weigh(token)
            name = word(token)
        self.own[token], self.gain[token] = own, gain
        if name in self.heard:
            self.telling[token] = self.heard[name]

    def weigh(self, token: str) -> tuple[list[float], float]:
        weights = [w for f in [*shape(token), "any"] if (w := self.model.emissions.get(f))]
        own = [sum(x) for x in zip([0.0] * 3, *weights)]
        return own, self.over(own)

    def bound(self, i: int, tokens: list[str]) -> float:
        """No less than the gain of a token in its place, without that of the file."""
        out = self.gain[tokens[i]]
        for k, (_, step) in enumerate(_BESIDE):
            at = i + step
            if 0 <= at < len(tokens):
                gains = self.telling.get(tokens[at])
                if gains:
                    out += gains[k]
            else:
                out += self.edge_gain[k]
        return out

    def emission(self, i: int, tokens: list[str], names: list[str], of_file: list[float]) -> list[float]:
        o, b, s = (x + y for x, y in zip(self.own[tokens[i]], of_file))
        for (_, step), d, edge in zip(_BESIDE, self.beside, self.edge):
            w = d.get(names[i + step]) if 0 <= i + step < len(names) else edge
            if w:
                o, b, s = o + w[0], b + w[1], s + w[2]
        return [o, b, s]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        tokens = set(_TOKEN.findall(text))
        if len(self.own) > KNOWN_TOKENS:
            self.own.clear(), self.gain.clear(), self.telling.clear()
        for t in tokens.difference(self.own):
            self.learn(t)
        weights = [w for f in file_features(text) if (w := self.model.emissions.get(f))]
        of_file = [sum(x) for x in zip([0.0] * 3, *weights)]
        telling, gain = self.telling, self.gain
        told = [telling[t] for t in tokens if t in telling]
        lacking = self.least - self.over(of_file)
        least = lacking - sum(max([0.0, e, *(g[k] for g in told)]) for k, e in enumerate(self.edge_gain))
        likely = {t for t in tokens if gain[t] >= least}
        if not likely:
            return []
        out, at = [], 0
        for line in text.split("\n"):
            words = _TOKEN.findall(line)
            if not likely.isdisjoint(words):
                open_ = [i for i, t in enumerate(words) if t in likely and self.bound(i, words) >= lacking]
                names = [word(t) for t in words] if open_ else []
                own = {i: self.emission(i, words, names, of_file) for i in open_}
                if any(self.over(e) >= self.least for e in own.values()):
                    places = [m.span() for m in _TOKEN.finditer(line)]
                    emissions = [own.get(i) or self.emission(i, words, names, of_file) for i in range(len(words))]
                    for (a, b), tag in zip(places, viterbi(emissions, self.model)):
                        if tag == BEGIN:
                            out.append(("crf", at + a, at + b))
                        elif tag == INSIDE:
                            out[-1] = ("crf", out[-1][1], at + b)
            at += len(line) + 1
        return out


def without(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """What of ``spans`` lies outside ``base``, trimmed of blanks and quotes; parts without a letter or digit go."""
    out = []
    for kind, a, b in spans:
        for _, x, y in [*sorted(base, key=lambda s: s[1:]), ("", b, b)]:
            if a < min(x, b):
                part = text[a : min(x, b)]
                first = a + len(part) - len(part.lstrip(" \t\"'"))
                last = first + len(part.strip(" \t\"'"))
                if any(c.isalnum() for c in text[first:last]):
                    out.append((kind, first, last))
            a = max(a, min(y, b))
    return out


def training_texts(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """About ``sample`` texts: by the hash of doc_id, half of those with a base span, half of the rest.

    One pass of the base patterns in the JVM marks every document; the table of marks says how many to take of either kind.
    Of rows that repeat a doc_id one is taken.
    """
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    marked = materialize(rows.select("doc_id", F.col("text").rlike(_ANY).alias("likely")).groupBy("doc_id").agg(F.max("likely").alias("likely")), "marks")
    counts = {r["likely"]: r["count"] for r in marked.groupBy("likely").count().collect()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.when(F.col("likely"), min(1.0, sample / 2 / max(1, counts.get(True, 0)))).otherwise(min(1.0, sample / 2 / max(1, counts.get(False, 0))))
    chosen = F.broadcast(marked.where(unit < rate).select("doc_id"))  # about ``sample`` ids
    return sorted(r["text"] for r in rows.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(training_texts(docs, sample))


def find_secrets(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True, drop_marked: bool = False) -> DataFrame:
    """Append n_assign, n_access, n_hex, base_sha256, spans (as kind:start:end, comma-joined) and secret_spans (structs).

    Spans are in code points, end exclusive, by start and then kind as in KINDS. Base spans always stay; what the CRF
    (``model``; None: base spans only) tags outside of them is added. Null and empty texts have none. Whole texts are
    read; repeated rows are scanned each; columns of those names that ``df`` has already are replaced. ``drop_marked``
    leaves out rows with any span.
    """

    def start():
        tagger = None if model is None else Tagger(model)

        def work(texts):
            out = [[] for _ in fields]
            for t in texts:
                base = base_spans(t) if t else []
                every = base
                if t and tagger and (more := tagger.spans(t)):
                    every = sorted(base + without(more, base, t), key=lambda s: (s[1], KINDS.index(s[0])))
                kinds = Counter(k for k, _, _ in base)
                values = (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), [{"kind": k, "start": a, "end": b} for k, a, b in every])
                for column, value in zip(out, values):
                    column.append(value)
            return out

        return work

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("secret_spans", T.ArrayType(span))]
    where = (lambda a, b, c, d, e, f: [not x for x in e]) if drop_marked else None
    return append_columns(df, start, fields, text, keep_text, where)
