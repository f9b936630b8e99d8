"""Standard headers of licences, as they stand in files, and what stands around them."""

import random

import brute

from cadenza.llm import licenses

APACHE = """Copyright 2024 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
LGPL3, AGPL3 = (GPL.replace("GNU General", f"GNU {x} General") for x in ("Lesser", "Affero"))
BSD3 = BSD + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
"""


def test_more_headers(spark):
    want = {GPL2: "GPL-2.0-or-later", LGPL21: "LGPL-2.1-or-later", LGPL3: "LGPL-3.0-or-later", AGPL3: "AGPL-3.0-or-later", BSD3: "BSD-3-Clause", ISC: "ISC", ZLIB: "Zlib", "// SPDX-License-Identifier: BSD-2-Clause\nint x;": "BSD-2-Clause"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scanned(df).collect()}
    assert got == {i: [x] for i, x in enumerate(want.values())}


def test_cues_come_from_the_known_sentences(spark):
    df = spark.createDataFrame([(1, "So there.\nUse at will.\nMore"), (2, "Use at Will!"), (3, "use at your will")], "doc_id long, text string")
    found = {r["doc_id"]: (r["license_sentences"], r["license"]) for r in licenses.scanned(df, {"wtf": "Use at will", "no": " ;. "}, (("W", ("wtf",)),)).collect()}
    assert found == {1: (["wtf"], "W"), 2: ([], None), 3: ([], None)} or found[2] == (["wtf"], "W") and found[1] == (["wtf"], "W") and found[3] == ([], None)
    assert licenses.scanned(df, {}, ()).collect()[0]["licenses"] == []
    every = [licenses.normalised(x) for x in licenses.SENTENCES.values()]
    assert all(any(c in s for c in licenses.cues(every)) for s in every) and len(licenses.cues(every)) < 20


def test_against_brute_force(spark):
    rng = random.Random(3)
    known = list(licenses.SENTENCES.values())
    filler = ["Some words of no licence stand here", "see the file COPYING", "Copyright 2024 Someone", "the Software is good", "License"]
    texts = [None, "", "\n\n;\n", APACHE, GPL, MPL, BSD, GPL2, LGPL21, BSD3, ISC, ZLIB]
    for _ in range(300):
        some = [rng.choice(known if rng.random() < 0.6 else filler) for _ in range(rng.randrange(1, 9))]
        text = "".join(x + rng.choice([". ", ".\n", "\n", "; ", "\n\n", ":\n", " "]) for x in some)
        if rng.random() < 0.5:
            w = text.split(" ")
            text = "".join(x + (rng.choice(["\n", "\r\n", "\n * "]) if rng.random() < 0.1 else " ") for x in w)
        texts.append(text.upper() if rng.random() < 0.1 else text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    n = 0
    for r in licenses.scanned(df).collect():
        want = brute.license_sentences(texts[r["doc_id"]], licenses.SENTENCES)
        assert r["license_sentences"] == want and r["licenses"] == brute.licenses(want, licenses.RULES, licenses.HIDES)
        n += len(want)
    assert n > 300


def test_standard_headers(spark):
    gpl = licenses.SENTENCES["gpl.free"] + ".\n" + licenses.SENTENCES["gpl.hope"] + "; without even the implied warranty.\n"
    wrapped = GPL.replace("as published by\nthe Free", "as published by the\nFree")
    commented = "".join(f" * {x}\n" for x in GPL.splitlines())
    rows = {1: (APACHE, ["Apache-2.0"]), 2: (GPL, ["GPL-3.0-or-later"]), 3: (MPL, ["MPL-2.0"]), 4: (BSD, ["BSD-2-Clause"]), 5: (gpl, ["GPL-3.0-or-later"]), 6: (wrapped, ["GPL-3.0-or-later"]), 7: (commented, ["GPL-3.0-or-later"])}
    rows |= {8: (MPL.replace("v. 2.0", "v.\n2.0"), ["MPL-2.0"]), 9: ("Not Released under the MIT License.", []), 10: (APACHE + "\n" + MPL, ["Apache-2.0", "MPL-2.0"]), 11: (MPL.replace("\n", "\r\n"), ["MPL-2.0"])}
    got = {r["doc_id"]: r["licenses"] for r in licenses.scanned(spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id long, text string")).collect()}
    assert got == {k: names for k, (_, names) in rows.items()}
