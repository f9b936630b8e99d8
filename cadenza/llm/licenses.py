"""License scans by sentence rules, by DataFrame functions only.

Parts of a text are normalised (lower case, runs of anything but letters, digits, dots and pluses as one space) and known
licence sentences are found in them, from one possible sentence end to another; a document's sequence of sentence identifiers is then matched against ordered rules: the
first rule whose identifiers occur in this order names the licence. A document may match several licences.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import let, table

# Public licence sentences, as they stand in the licences' texts and usual notices; a semicolon ends one.
SENTENCES = {
    "mit.notice": "Released under the MIT License",
    "mit.licensed": "Licensed under the MIT License",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit.condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "boost.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "boost.notice": "Distributed under the Boost Software License, Version 1.0",
    "apache2.notice": "Licensed under the Apache License, Version 2.0",
    "apache2.header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2.comply": "you may not use this file except in compliance with the License",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl.library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gnu.program": "This program is free software",
    "gnu.library": "This library is free software",
    "gpl.terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl.terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "gnu.later2": "either version 2 of the License, or (at your option) any later version",
    "gnu.later21": "either version 2.1 of the License, or (at your option) any later version",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd.redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "mpl2.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "epl2.notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "zlib.freely": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib.origin": "The origin of this software must not be misrepresented",
    "ccbync4.notice": "Licensed under CC BY-NC 4.0",
    "ccby4.notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa4.notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ccbync4.work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0.notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc.and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense.domain": "This is free and unencumbered software released into the public domain",
    "wtfpl.title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
}
# Rules in the order they are tried within a licence; (licence, identifiers that occur in this order).
RULES = (
    ("MIT", ("mit.grant", "mit.condition")),
    ("MIT", ("mit.notice",)),
    ("MIT", ("mit.licensed",)),
    ("BSL-1.0", ("boost.grant",)),
    ("BSL-1.0", ("boost.notice",)),
    ("Apache-2.0", ("apache2.header", "apache2.comply")),
    ("Apache-2.0", ("apache2.notice",)),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope")),
    ("GPL-2.0-or-later", ("gnu.program", "gpl.terms", "gnu.later2", "gpl.hope")),
    ("LGPL-3.0-or-later", ("lgpl.free", "gpl.hope")),
    ("LGPL-3.0-or-later", ("lgpl.library", "lgpl.hope")),
    ("LGPL-2.1-or-later", ("gnu.library", "lgpl.terms", "gnu.later21", "lgpl.hope")),
    ("AGPL-3.0-or-later", ("agpl.free", "gpl.hope")),
    ("GPL-3.0-only", ("gpl3.notice",)),
    ("BSD-4-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.advertise")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")),
    ("MPL-2.0", ("mpl2.notice",)),
    ("EPL-2.0", ("epl2.notice",)),
    ("Zlib", ("zlib.freely", "zlib.origin")),
    ("CC-BY-NC-4.0", ("ccbync4.notice",)),
    ("CC-BY-NC-4.0", ("ccbync4.work",)),
    ("CC-BY-4.0", ("ccby4.notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4.notice",)),
    ("CC0-1.0", ("cc0.notice",)),
    ("ISC", ("isc.grant",)),
    ("ISC", ("isc.and",)),
    ("0BSD", ("0bsd.grant",)),
    ("Unlicense", ("unlicense.domain",)),
    ("WTFPL", ("wtfpl.title",)),
)
#: A rule that holds hides the licences named here, whose sentences are a part of its own.
HIDES = {"BSD-4-Clause": ("BSD-3-Clause", "BSD-2-Clause"), "BSD-3-Clause": ("BSD-2-Clause",)}
# Identifiers of the SPDX list that stand in one-line tags of files.
TAGGED = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
          "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-2.0", "EPL-2.0", "ISC", "0BSD", "Zlib", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense", "WTFPL")
SENTENCES |= {f"spdx.{x.lower()}": f"SPDX-License-Identifier: {x}" for x in TAGGED}
RULES += tuple((x, (f"spdx.{x.lower()}",)) for x in TAGGED)


#: Stands in a part where a sentence may end.
END = "\x01"


def normalised(sentence: str) -> str:
    """Lower case; every run of other characters than letters, digits, dots and pluses is a space; no dot at the end."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c in ".+" else " " for c in sentence.lower()).split()).strip(" .")


def parts(text: Column) -> Column:
    """The parts of a text, cut at blank lines and semicolons."""
    return F.split(F.coalesce(text, F.lit("")), r"\n\s*\n|;")


def marked(part: Column) -> Column:
    """A part, normalised, with END where a sentence may end: after . ! ? at a line's end or before a capital, after a colon at
    a line's end, after the line of an SPDX tag, and at a line that starts with a capitalised word, which may as well be wrapped."""
    ends = F.regexp_replace(part, r"(?<=[.!?:])[ \t\r]*\n|(?<=SPDX-License-Identifier:[^\n]{1,40})\n|\n(?=\p{Lu}\p{Ll})|(?<=[.!?])[ \t]+(?=\p{Lu})", END)
    return F.regexp_replace(F.regexp_replace(F.lower(ends), rf"[^\p{{L}}\p{{N}}.+{END}]+", " "), f"[ {END}]*{END}[ {END}]*", END)


def _pattern(sentences: list[str]) -> str:
    """Any of the sentences, normalised, between two possible ends; the longest first."""
    words = [f"[ {END}]".join(re.escape(w) for w in s.split()) for s in sorted(sentences, key=len, reverse=True)]
    return rf"(?:^|(?<={END}))[ .]*({'|'.join(words)})(?=[ .]*(?:{END}|$))"


def cues(sentences: list[str], long: int = 7) -> list[str]:
    """Few rare words so that each sentence (normalised) holds one at least, as a word or within one: of words of `long` letters or
    more, or a sentence's longest one, the one that most sentences hold, then of the sentences left, and so on. A text without any of
    them holds no sentence."""
    left, out = [s for s in sentences if s], []
    while left:
        words = {w for s in left for w in s.split() if len(w) >= min(long, max(map(len, s.split())))}
        out.append(max(sorted(words), key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


def _hiding(name: str, hidden: tuple[str, ...]):
    return lambda h: F.when(F.array_contains(h, name), F.array_except(h, F.array(*[F.lit(x) for x in hidden]))).otherwise(h)


def scanned(docs: DataFrame, known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """docs with license_sentences (known identifiers in text order, each occurrence), licenses (of all rules that hold, in
    rule order, distinct) and license (the first, or null).

    One pass, no shuffle. Only parts that hold one of the known sentences' cues are normalised. A null or empty text has no
    sentences, a known sentence without a word is in no text, and of two known sentences that are alike the first counts. Columns
    of docs with these names are replaced; rows are kept, repeated ones too; an empty table gives an empty table.
    """
    docs = docs.drop("license_sentences", "licenses", "license")
    of = {}
    for i, sentence in known.items():
        of.setdefault(normalised(sentence), i)
    of.pop("", None)
    none = F.array().cast("array<string>")
    if not of:
        return docs.select("*", none.alias("license_sentences"), none.alias("licenses"), F.lit(None).cast("string").alias("license"))
    cue = "|".join(re.escape(w) for w in cues(list(of)))
    table_of = F.create_map(*[F.lit(x) for s, i in of.items() for x in (s, i)])  # folded to one literal
    pattern = F.lit(_pattern(list(of)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    there = F.flatten(F.transform(F.filter(parts(text), lambda s: F.lower(s).rlike(cue)), lambda s: F.regexp_extract_all(marked(s), pattern, F.lit(1))))
    found = F.transform(there, lambda s: F.try_element_at(table_of, F.translate(s, END, " ")))
    # in a generator of one row: no filter on the results is pushed below it, where it would scan again
    out = docs.select("*", F.explode(F.array(F.when(F.lower(text).rlike(cue), found).otherwise(none))).alias("license_sentences"))

    def holds(ids: tuple[str, ...]) -> Column:
        seq = F.col("license_sentences")
        step = F.aggregate(seq, F.lit(0), lambda at, s: F.when(s == F.get(F.array(*[F.lit(i) for i in ids]), at), at + 1).otherwise(at))
        return step == len(ids)

    hits = F.array_distinct(F.array_compact(F.array(*[F.when(holds(ids), F.lit(name)) for name, ids in rules])))
    for name, hidden in HIDES.items():
        hits = let(hits, _hiding(name, hidden))
    return out.withColumn("licenses", F.when(F.size("license_sentences") == 0, none).otherwise(hits)).withColumn("license", F.get("licenses", F.lit(0)))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's licences by sentence rules."""
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), F.array_join("license_sentences", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), "license")
