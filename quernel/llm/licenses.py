"""Licence scans by sentence rules.

Texts are cut into sentences, and every sentence is normalised (lower case, single blanks, no quotes, list marks,
comment marks or addresses) and looked up in a table of known licence sentences, some of which have a slot for a name.
Sentences that grant licences by name ("this file is released under ...") are known sentences whatever leads up to the
grant, unless it is denied or asked; so are lines that only name a licence, as titles and fields do. The identifiers found,
in the order of the text, are then matched against rules: ordered lists of identifiers that may stand apart by a bounded
number of other sentences.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernel.llm.common import append_columns

# Sentences of well-known licences, after normalisation without final stop; {} is a slot for a name.
SENTENCES = {
    "apache-grant": "licensed under the apache license, version 2.0 (the license)",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-asf": "licensed to the apache software foundation (asf) under one or more contributor license agreements",
    "apache-asf-grant": "the asf licenses this file to you under the apache license, version 2.0 (the license)",
    "mit-grant": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "gpl-free": "this program is free software",
    "gpl-free-2": "{} is free software",
    "lgpl-free": "this library is free software",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
    "gpl3-terms-2": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 3 of the license, or (at your option) any later version",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-only-2": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; version 2 of the license",
    "gpl3-only": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, version 3 of the license",
    "lgpl2-terms": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
    "lgpl3-terms-2": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 3 of the license, or (at your option) any later version",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope-2": "{} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-hope": "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-2": "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-3": "the name of {} may not be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license, v. 2.0",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file, you can obtain one at",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",
    "epl2-terms-2": "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution, and is available at",
    "zlib-as-is": "this software is provided as-is, without any express or implied warranty",
    "zlib-event": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following",
    "isc-grant": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gfdl13-terms": "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license, version 1.3 or any later version published by the free software foundation",
    "0bsd-grant": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
}
# Licence, ordered sentences that all occur.
RULES = [
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-asf", "apache-asf-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-asf-grant"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms-2", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-only", ["gpl-free", "gpl3-only", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-only", ["gpl-free", "gpl2-only"]),
    ("GPL-2.0-only", ["gpl-free", "gpl2-only-2"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl2-terms", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms-2", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms", "gpl-hope", "lgpl-see"]),
    ("LGPL-2.1-or-later", ["gpl-free", "lgpl2-terms", "gpl-hope", "lgpl-see"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms", "gpl-hope", "agpl-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl-subject", "mpl-obtain"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-2.0", ["epl2-terms-2"]),
    ("Zlib", ["zlib-as-is", "zlib-event", "zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("ISC", ["isc-grant"]),
    ("GFDL-1.3-or-later", ["gfdl13-terms"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl"]),
]
# Sentences that say the same as another.
SAME = {"gpl-free-2": "gpl-free", "gpl-hope-2": "gpl-hope", "bsd-endorse-2": "bsd-endorse", "bsd-endorse-3": "bsd-endorse", "isc-grant-2": "isc-grant"}
# Names by which grants call licences, normalised, without "the" before and "license" after them.
NAMES = {
    "MIT": ["mit", "expat", "mit/x11", "x11"],
    "Apache-2.0": ["apache license, version 2.0", "apache license version 2.0", "apache license 2.0", "apache license, version 2", "apache license v2.0", "apache 2.0", "apache 2", "apache-2.0", "apache software license 2.0", "asl 2.0"],
    "GPL-3.0": ["gnu general public license, version 3", "gnu general public license version 3", "gnu general public license v3", "gnu general public license v3.0", "gnu gpl v3", "gnu gpl version 3", "gpl v3", "gplv3", "gpl-3.0", "gpl 3", "gpl version 3"],
    "GPL-2.0": ["gnu general public license, version 2", "gnu general public license version 2", "gnu general public license v2", "gnu general public license v2.0", "gnu gpl v2", "gnu gpl version 2", "gpl v2", "gplv2", "gpl-2.0", "gpl 2", "gpl version 2"],
    "LGPL-3.0": ["gnu lesser general public license, version 3", "gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgpl v3", "lgplv3", "lgpl-3.0"],
    "LGPL-2.1": ["gnu lesser general public license, version 2.1", "gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "gnu lgpl v2.1", "lgpl v2.1", "lgplv2.1", "lgpl-2.1"],
    "AGPL-3.0": ["gnu affero general public license, version 3", "gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl v3", "agplv3", "agpl-3.0"],
    "BSD-3-Clause": ["bsd 3-clause", "3-clause bsd", "bsd-3-clause", "new bsd", "modified bsd", "three-clause bsd"],
    "BSD-2-Clause": ["bsd 2-clause", "2-clause bsd", "bsd-2-clause", "simplified bsd", "two-clause bsd"],
    "MPL-2.0": ["mozilla public license, version 2.0", "mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license, v. 2.0", "mozilla public license v2.0", "mpl 2.0", "mpl-2.0", "mpl v2"],
    "EPL-2.0": ["eclipse public license, version 2.0", "eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license - v 2.0", "epl 2.0", "epl-2.0"],
    "BSL-1.0": ["boost software license, version 1.0", "boost software license version 1.0", "boost software license 1.0", "boost software", "bsl-1.0"],
    "ISC": ["isc"],
    "OFL-1.1": ["sil open font license, version 1.1", "sil open font license version 1.1", "sil open font license 1.1", "sil ofl 1.1", "sil ofl", "ofl-1.1", "open font license 1.1", "sil open font"],
    "Artistic-2.0": ["artistic license 2.0", "artistic license, version 2.0", "artistic license version 2.0", "artistic 2.0", "artistic-2.0"],
    "CDDL-1.0": ["common development and distribution license, version 1.0", "common development and distribution license version 1.0", "common development and distribution license 1.0", "common development and distribution license (cddl) version 1.0", "cddl 1.0", "cddl-1.0"],
    "GFDL-1.3": ["gnu free documentation license, version 1.3", "gnu free documentation license version 1.3", "gnu free documentation license 1.3", "gfdl 1.3", "gfdl-1.3"],
    "Zlib": ["zlib", "zlib/libpng"],
    "0BSD": ["0bsd", "zero-clause bsd", "bsd zero clause"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public"],
    "CC0-1.0": ["cc0 1.0", "cc0", "cc0-1.0", "cc0 1.0 universal", "creative commons zero", "creative commons zero v1.0 universal", "creative commons cc0 1.0 universal"],
}
# Parts of the names of Creative Commons licences.
_CC_PARTS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("4.0", "3.0", "2.0")


def licence_names() -> dict[str, str]:
    """Licence by name, with the names of Creative Commons licences made from their parts."""
    out = {name: licence for licence, names in NAMES.items() for name in names}
    for kind in _CC_KINDS:
        parts = [_CC_PARTS[p] for p in kind.split("-")]
        for version in _CC_VERSIONS:
            short, licence = f"cc {kind} {version}", f"CC-{kind.upper()}-{version}"
            for name in (short, f"cc-{kind} {version}", f"cc-{kind}-{version}", f"creative commons {kind} {version}"):
                out[name] = licence
            for joined in {"-".join(parts), " ".join(parts), "-".join(p.replace("non", "non-", 1).replace("noderiv", "no-deriv").replace("sharealike", "share-alike").replace("nonno-", "nonno") for p in parts)}:
                for tail in (f"{version}", f"{version} international", f"{version} unported", f"{version} international ({short})"):
                    out[f"creative commons {joined} {tail}"] = licence
    return out


CUTS = 6  # places at which a list of names may be cut
SLOT = 120  # characters of the name in a slot
GAP = 6  # unknown or other sentences that may stand between two of a rule
# a sentence ends at a stop before white space or the end, at : before a break, or at an empty line, also one
# of comment marks alone
_END = re.compile(r"(?<!\bv)[.!?](?=\s|$)|:(?=\s*\n|\s*$)|\n[\s*#>/;-]*\n|(?<=free software):", re.I)
_MARKS = re.compile(r"""["'“”‘’`*#>]|^\s*(?:\(?[0-9a-z][.)]|//|--|;;)\s""", re.I | re.M)
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_ADDRESS = re.compile(r"<?(?:https?://|www\.)[^\s<>\"')]+[)>]?", re.I)
# inside a line a notice may follow a comment mark
_COMMENT = re.compile(r"\n|(?<=\s)(?:#|//|/\*|--|;;)|<!--")
# a grant by name, whatever leads up to it
_LEAD = r"(?:(?:this|these|the|all|our|my|its|it|unless|except|dual|code|source|software|and|is|are)\b[\w ,/&()-]{0,100}? )?"
_GRANT = re.compile(_LEAD + r"(?:also |hereby |dual[ -])?(?:licen[sc]ed|released|distributed|published|provided|shared|offered|redistributed|(?:made )?available|covered|governed)(?: to you)?(?: by| under)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? (.+)")
_AFTER = re.compile(r"(?: licen[sc]e)?(?:(?:,| -)? (?:see|as|which|and|found|that|for|at your option|at your choice)\b.*| \(.*)?$")
_NOT = re.compile(r"\b(?:not|never|no longer|neither|nor|cannot|(?:is|are|was|were|ca)n t)\b")
_EITHER = re.compile(r"^(?:(?:either|both|any|one)(?: of)?(?: the)?|(?:the|an?)) ")
_JOINED = re.compile(r"(?:(?:,? (?:and/or|and|or|as well as))|,)(?: under)?(?: the| an?)? ")
_SPDX = re.compile(r"spdx-license-identifier: (.+)$")
_TERM = re.compile(r"[()]|[\w.+-]+")
#: A line that is a title, or a field: of a header, a file of settings, or a list of packages.
_TITLE = re.compile(r"""^[ \t#*/;-]*(?:the )?([\w.,+/ -]{2,80}?) licen[sc]e(?: \(([\w.+ -]{2,30})\))?[ \t*#/]*$""", re.I | re.M)
_FIELD = re.compile(r"""^[ \t#*/;"'-]*licen[sc]e["']?[ \t]*[:=][ \t]*["']?([\w.+() -]{2,80}?)["']?[ \t]*[,;]?[ \t]*$""", re.I | re.M)


def normalise(sentence: str) -> str:
    plain = _BLANK.sub(" ", _MARKS.sub(" ", _ADDRESS.sub(" ", sentence))).strip(" .,;:-/").lower()
    return plain.replace(" ,", ",").replace("( ", "(").replace(" )", ")").strip()


def by_name(name: str, names: dict[str, str]) -> str | None:
    """The licence that a normalised name means, with or without "license" and what may follow it."""
    for tail in (name, re.sub(r" licen[sc]e$", "", name), _AFTER.sub("", name), _AFTER.sub("", name).removesuffix(" public"), re.sub(r" licen[sc]e\b.*$", "", name)):
        if tail in names:
            return names[tail]
    return None


def spdx_licences(expression: str, names: dict[str, str]) -> list[str]:
    """The licences of an SPDX expression in lower case, in their order; one WITH an exception is one of its own. None that is not known."""
    out: list[str] = []
    terms = _TERM.findall(expression)
    for i, term in enumerate(terms):
        if term in ("(", ")", "or", "and", "with") or i and terms[i - 1] == "with":
            if i and terms[i - 1] == "with" and out:
                out[-1] += " WITH " + term
            continue
        licence = names.get("spdx " + term) or names.get("spdx " + term.removesuffix("+"))
        if not licence:
            return []
        out.append(licence)
    return list(dict.fromkeys(out))


def named_licences(sentence: str, names: dict[str, str]) -> list[str]:
    """The licences that a normalised sentence grants by name, or by SPDX identifiers; none if it denies the grant."""
    if m := _SPDX.match(sentence):
        return spdx_licences(m[1], names)
    m = _GRANT.match(sentence)
    if not m or _NOT.search(sentence[: m.start(1)]):
        return []
    name = _EITHER.sub("", m[1])
    # names may have a comma or "and" in them: the fewest parts that are names each
    cuts = [c.span() for c in _JOINED.finditer(name)][:CUTS]
    for number in range(len(cuts) + 1):
        for some in itertools.combinations(cuts, number):
            parts = [name[a:b] for a, b in zip([0, *(c[1] for c in some)], [*(c[0] for c in some), len(name)])]
            found = [by_name(_EITHER.sub("", part), names) for part in parts]
            if all(found) and (number or not any(by_name(_EITHER.sub("", name[c[1] :]), names) not in (None, found[0]) for c in cuts)):
                return list(dict.fromkeys(found))
    return []


@dataclass(frozen=True)
class Rules:
    """Sentences by normalised text, licences by name, rules by first sentence (longest first), and a pattern that every known sentence matches."""

    ids: dict[str, str]
    slots: list[tuple[str, str, str]]  # what stands before and behind the slot of a sentence, and its identifier
    names: dict[str, str]
    by_first: dict[str, list[tuple[str, list[str]]]]
    hint: re.Pattern
    most_words: int

    @staticmethod
    def of(sentences: dict[str, str], rules: list[tuple[str, list[str]]], names: dict[str, str] | None = None) -> Rules:
        every = {normalise(t): SAME.get(k, k) for k, t in sentences.items()}
        ids = {t: k for t, k in every.items() if "{}" not in t}
        slots = [(*t.split("{}"), k) for t, k in every.items() if "{}" in t]
        names = dict(names or {})
        rules = list(rules)
        for licence in sorted(set(names.values())):
            rules.append((licence, ["grant:" + licence]))
            names["spdx " + licence.lower()] = licence
        for suffix in ("-only", "-or-later"):
            for licence in sorted({x for x in names.values() if "GPL-" in x and x[-1].isdigit()}):
                names["spdx " + (licence + suffix).lower()] = licence + suffix
                rules.append((licence + suffix, ["grant:" + licence + suffix]))
        by_first: dict[str, list[tuple[str, list[str]]]] = {}
        for name, sequence in sorted(rules, key=lambda r: -len(r[1])):
            by_first.setdefault(sequence[0], []).append((name, sequence))
        # long words that cover the table: texts without any of them have no known sentence
        left, cover = {i: set(re.findall(r"[a-z0-9]{7,}", i)) or set(i.split()) - {"{}"} for i in every}, []
        while left:
            best = max(sorted({w for ws in left.values() for w in ws}), key=lambda w: (sum(w in ws for ws in left.values()), len(w)))
            cover.append(best)
            left = {i: ws for i, ws in left.items() if best not in ws}
        cover = [re.escape(w) for w in cover] + ([r"\bunder\b", r"\bby\s+the\b", r"\blicen[sc]e\b", "spdx-license-identifier"] if names else [])
        longest = max((len(_WORD.findall(i)) for i in every), default=0)
        return Rules(ids, slots, names, by_first, re.compile("|".join(cover), re.I | re.A), max(longest, 40 if names else 0))

    def identify(self, sentence: str, asked: bool = False) -> list[str]:
        """The identifiers of a sentence as it stands in a text; a question (``asked``) grants nothing."""
        plain = normalise(sentence)
        if plain in self.ids:
            return [self.ids[plain]]
        for before, behind, name in self.slots:
            if plain.startswith(before) and plain.endswith(behind) and len(before) + len(behind) < len(plain) <= len(before) + len(behind) + SLOT:
                return [name]
        if not self.names or asked or ";" in plain:  # clauses are looked at one by one
            return []
        if "under" in plain or " by " in plain or plain.startswith("spdx"):
            return ["grant:" + licence for licence in named_licences(plain, self.names)]
        return []

    def line(self, m: re.Match) -> list[str]:
        """The identifiers of a title or a field."""
        for part in filter(None, m.groups()):
            plain = normalise(part)
            found = spdx_licences(plain, self.names) if m.re is _FIELD else []
            if not found and (licence := by_name(plain, self.names)):
                found = [licence]
            if found:
                return ["grant:" + licence for licence in found]
        return []


def sentences(text: str):
    """(start, end) of sentences."""
    begin = 0
    for m in _END.finditer(text):
        yield begin, m.start()
        begin = m.end()
    yield begin, len(text)


def _trimmed(text: str, a: int, b: int) -> int:
    part = text[a:b]
    return a + len(part) - len(part.lstrip())


def _ending(text: str, a: int, b: int, rules: Rules, asked: bool) -> tuple[int, list[str]] | None:
    """(start, identifiers) of the known sentence that ends a stretch of text: all of it, or from a line or comment mark on.

    Starts are tried from the last one backwards, up to as many words as the longest known sentence has.
    """
    if not rules.hint.search(text, a, b):
        return None
    if names := rules.identify(text[a:b], asked):
        return _trimmed(text, a, b), names
    words, end = 0, b
    for cut in reversed([m.end() for m in _COMMENT.finditer(text, a, b)]):
        own = len(_WORD.findall(normalise(text[cut:end])))
        end = cut
        words += own
        if words > rules.most_words:
            break
        if own and (names := rules.identify(text[cut:b], asked)):
            return _trimmed(text, cut, b), names
    return None


def known_sentences(text: str, rules: Rules) -> list[tuple[int, int, int, str]]:
    """(place among the sentences, start, end, identifier) of those in the table.

    A sentence may follow lines that no stop ends (see ``_ending``). One that is not known may be several clauses that
    end at semicolons. A sentence that grants several licences stands once for each. Lines that only name a licence
    count where no known sentence has them.
    """
    found, lines = [], []
    if rules.names:
        lines = [(m.start(), m.end(), names) for pattern in (_TITLE, _FIELD) for m in pattern.finditer(text) if (names := rules.line(m))]
    for k, (a, b) in enumerate(sentences(text)):
        own = [x for x in lines if a <= x[0] < b] if lines else []
        if not own and not rules.hint.search(text, a, b):
            continue
        asked = text[b : b + 1] == "?"
        clauses, at = [], a
        if ";" in text[a:b] and not rules.identify(text[a:b], asked):
            for part in text[a:b].split(";"):
                if hit := _ending(text, at, at + len(part), rules, asked):
                    clauses += [(k, hit[0], at + len(part), name) for name in hit[1]]
                at += len(part) + 1
        if not clauses and (hit := _ending(text, a, b, rules, asked)):
            clauses = [(k, hit[0], b, name) for name in hit[1]]
        for first, last, names in own:
            if not any(x < last and y > first for _, x, y, _ in clauses):
                clauses += [(k, _trimmed(text, first, last), last, name) for name in names]
        found += sorted(clauses, key=lambda c: c[1])
    return found


def match_rules(found: list[tuple[int, int, int, str]], rules: Rules, gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, start, end): at each place the longest rule whose sentences follow in order; its sentences are used up."""
    out, i = [], 0
    used: set[int] = set()
    for i, (_, start, end, name) in enumerate(found):
        if i in used:
            continue
        for licence, sequence in rules.by_first.get(name) or ([(name[6:], [name])] if name.startswith("grant:") else []):
            at, j, last = [i], i + 1, found[i][0]
            for wanted in sequence[1:]:
                while j < len(found) and found[j][0] - last <= gap + 1 and (j in used or found[j][3] != wanted):
                    j += 1
                if j == len(found) or found[j][0] - last > gap + 1:
                    break
                at.append(j)
                last, j = found[j][0], j + 1
            if len(at) == len(sequence):
                used.update(at)
                out.append((licence, start, found[at[-1]][2]))
                break
    return out


def scan_licences(df: DataFrame, text: str = "text", sentences_by_id: dict[str, str] | None = None, rule_list: list[tuple[str, list[str]]] | None = None, gap: int = GAP, keep_text: bool = True) -> DataFrame:
    """Append n_sentences (known licence sentences), licenses (distinct names, sorted) and license_spans to every row.

    license_spans are structs of license, start and end (code points, end exclusive) in the order of the text. Null
    and empty texts have none. Whole texts are read; repeated rows are scanned each; columns of the three names that
    ``df`` has already are replaced.
    """
    rules = Rules.of(sentences_by_id or SENTENCES, rule_list or RULES, licence_names() if sentences_by_id is None else None)

    def start():
        def work(texts):
            counts, names, spans = [], [], []
            for t in texts:
                found = known_sentences(t, rules) if t and rules.hint.search(t) else []
                hits = match_rules(found, rules, gap) if found else []
                counts.append(len(found))
                names.append(sorted({h[0] for h in hits}))
                spans.append([{"license": n, "start": a, "end": b} for n, a, b in hits])
            return counts, names, spans

        return work

    span = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("n_sentences", T.LongType()), T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("license_spans", T.ArrayType(span))]
    return append_columns(df, start, fields, text, keep_text)
