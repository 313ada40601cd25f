"""Grants by name, notices of every rule in many layouts, texts that grant nothing, and the rule matcher against brute force."""

import random

import pytest

from quernel.llm import licenses

RULES = licenses.Rules.of(licenses.SENTENCES, licenses.RULES, licenses.licence_names())


def found(text, rules=RULES):
    known = licenses.known_sentences(text, rules) if rules.hint.search(text) else []
    return sorted({n for n, _, _ in licenses.match_rules(known, rules)})


GRANTS = {
    "This file is released under the MIT License.": "MIT",
    "x = 1\n# Released under the MIT License.": "MIT",
    "import os  # Licensed under the MIT license": "MIT",
    "int x; // Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "<!-- This work is licensed under a Creative Commons Attribution 4.0 International License. -->": "CC-BY-4.0",
    "Except where otherwise noted, content on this site is licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "The code is made available under the terms of the GNU General Public License v3.": "GPL-3.0",
    "All files are covered by the ISC license": "ISC",
    "This project is licensed under the Apache License 2.0 - see the LICENSE file for details.": "Apache-2.0",
    "This software is available under the 3-Clause BSD License.": "BSD-3-Clause",
    "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "Dedicated text\n\nReleased under CC0 1.0": "CC0-1.0",
    "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "Apache-2.0",
}
NOTHING = [
    "The results were published under the direction of the board.",
    "He was released under the condition that he stays.",
    "A driving licence is required; apply at the office.",
    "Permission is hereby granted to enter the building.",
    "This program is free software.",
    "We compared the MIT License with the Apache License.",
    "Data shared under the table by the wind",
    "It is covered by the insurance license of the state",
    "",
]


@pytest.mark.parametrize("text", GRANTS)
def test_grants(text):
    assert found(text) == [GRANTS[text]]
    prose = "Some prose before it\nwithout a stop\n"
    assert found(prose + text + "\n\nand more of it.") == [GRANTS[text]]


_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
#: Notices as they stand in the world, none made from the table.
NOTICES = {
    _BSD + "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": ["BSD-3-Clause"],
    _BSD: ["BSD-2-Clause"],
    "dual licensed under the MIT license and the Apache License, Version 2.0": ["Apache-2.0", "MIT"],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": ["ISC"],
    "GNU Bison is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nBison is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.": ["GPL-3.0-or-later"],
    "# Licensed to the Apache Software Foundation (ASF) under one or more\n# contributor license agreements.  See the NOTICE file distributed with\n# this work for additional information regarding copyright ownership.\n# The ASF licenses this file to You under the Apache License, Version 2.0\n# (the \"License\"); you may not use this file except in compliance with\n# the License.  You may obtain a copy of the License at\n#\n#    http://www.apache.org/licenses/LICENSE-2.0\n": ["Apache-2.0"],
    "MIT License\n\nCopyright (c) 2020 Jane Doe\n": ["MIT"],
    "The MIT License (MIT)\nCopyright (c) 2020 Jane Doe\n": ["MIT"],
    "Name: x\nLicense: MIT\nVersion: 2": ["MIT"],
    '[package]\nname = "x"\nlicense = "Apache-2.0"\n': ["Apache-2.0"],
    '{\n  "license": "MIT OR Apache-2.0",\n}': ["Apache-2.0", "MIT"],
    "// SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
    "/* SPDX-License-Identifier: (GPL-2.0-only AND MIT) */": ["GPL-2.0-only", "MIT"],
    "# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": ["GPL-2.0-only WITH linux-syscall-note"],
    _MIT: ["MIT"],
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": ["OFL-1.1"],
    "This module is distributed under the Artistic License 2.0": ["Artistic-2.0"],
    "The contents of this file are made available under the Common Development and Distribution License 1.0.": ["CDDL-1.0"],
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;": ["GFDL-1.3-or-later"],
}
DENIED = ["This is not licensed under the MIT license.", "Is this licensed under the MIT license?", "The code isn't released under the MIT License.", "It was never distributed under the ISC license.", "My licence is old\nThe plan is free software\n", "a licence = x", "Drivers License\n", "the old license\n\nand"]


@pytest.mark.parametrize("text", NOTICES)
def test_notices(text):
    assert found(text) == NOTICES[text]
    assert found("Some prose before it.\n\n" + text + "\n\nand more of it.") == NOTICES[text]


@pytest.mark.parametrize("text", DENIED)
def test_denied_and_asked(text):
    assert found(text) == []


def test_sentences_against_plain_lookup():
    """Sentences drawn from the table, from names and from prose, one a line with a stop: identified as the table says."""
    rng, names = random.Random(3), licenses.licence_names()
    plain = {licenses.normalise(t): licenses.SAME.get(k, k) for k, t in licenses.SENTENCES.items() if "{}" not in t and ";" not in t and ":" not in t}
    for _ in range(200):
        text, want = "", []
        for _ in range(rng.randint(1, 8)):
            kind = rng.randrange(3)
            if kind == 0:
                sentence = rng.choice(sorted(plain))
                want.append(plain[sentence])
            elif kind == 1:
                name = rng.choice(sorted(names))
                sentence = f"this file is released under the {name}"
                want.append("grant:" + names[name])
            else:
                sentence = rng.choice(["a plain sentence of no note", "it was seen under the bridge by the lake", "the license of the driver was old"])
            text += sentence.capitalize() + ".\n"
        assert [k for _, _, _, k in licenses.known_sentences(text, RULES)] == want


@pytest.mark.parametrize("text", NOTHING)
def test_texts_that_grant_nothing(text):
    assert found(text) == []


def test_every_name_and_every_rule():
    for name, licence in licenses.licence_names().items():
        for text in (f"Released under the {name} license.", f"This file is licensed under {name.upper()}"):
            assert found(text) == [licence], text
    for licence, sequence in licenses.RULES:
        body = ".\n".join(licenses.SENTENCES[k].capitalize() for k in sequence) + ".\n"
        assert licence in found(body), licence
        assert licence in found("".join(f" * {line}\n" for line in body.split("\n"))), licence
        words = body.split(" ")
        wrapped = "".join(w + ("\n# " if i % 9 == 8 else " ") for i, w in enumerate(words))
        assert licence in found("# " + wrapped), licence


def test_matcher_agrees_with_brute_force():
    rules = licenses.Rules.of({k: f"sentence {k}" for k in "abcd"}, [("X", list("abc")), ("Y", list("ab")), ("Z", list("d")), ("W", list("ca"))])
    rng = random.Random(5)

    def brute(seen, gap):
        used, out = set(), []
        for i, (_, _, _, first) in enumerate(seen):
            if i in used:
                continue
            for licence, wanted in sorted([("X", "abc"), ("Y", "ab"), ("Z", "d"), ("W", "ca")], key=lambda r: -len(r[1])):
                if wanted[0] != first:
                    continue
                at, ok = [i], True
                for w in wanted[1:]:
                    later = [j for j in range(at[-1] + 1, len(seen)) if j not in used and seen[j][3] == w and seen[j][0] - seen[at[-1]][0] <= gap + 1]
                    if not later:
                        ok = False
                        break
                    at.append(later[0])
                if ok:
                    used.update(at)
                    out.append((licence, seen[i][1], seen[at[-1]][2]))
                    break
        return out

    for _ in range(2000):
        place, seen = 0, []
        for _ in range(rng.randint(0, 9)):
            place += rng.randint(1, 3)
            seen.append((place, 10 * place, 10 * place + 5, rng.choice("abcd")))
        assert licenses.match_rules(seen, rules, 2) == brute(seen, 2)


def test_long_lines_without_stops_take_time_in_proportion():
    import time

    def seconds(n):
        text = "under some words of a long line\n" * n
        began = time.perf_counter()
        assert found(text) == []
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.005)
