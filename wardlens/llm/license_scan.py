"""Licence scans by sentence rules (operator 8).

Normalised sentences are mapped to identifiers of known licence sentences; the sequence
of identifiers in a text is matched against ordered rules.  A rule names its sentences
in order; others may stand between them.  Longer rules go first and take their
sentences, so the full MIT text is one finding and not three.  ``<*>`` in a sentence is a
variable field of up to ``FIELD_WORDS`` words, such as a holder's name.  Lines with an
SPDX-License-Identifier tag are read as expressions and name their licences directly.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_doc_id, doc_rows, record, small_batches, strings_of

# Sentences of public licences, by identifier.
SENTENCES = {
    "mit.name": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License", "The MIT License (MIT)"],
    "mit.grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit.notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "asis.software": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache2.name": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004"],
    "apache2.use": ["you may not use this file except in compliance with the License."],
    "apache2.copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2.asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl3.name": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl.free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl.useful": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsd.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc.by-nc-4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc.by-4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc.by-sa-4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc.zero": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
    "reserved": ["All rights reserved."],
    "bsd.name2": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "bsd.name3": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc.name": ["Licensed under the ISC License.", "Released under the ISC License.", "ISC License"],
    "0bsd.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "unlicense.free": ["This is free and unencumbered software released into the public domain."],
    "unlicense.name": ["Released under the Unlicense.", "Licensed under the Unlicense.", "The Unlicense"],
    "mpl2.form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2.name": ["Licensed under the Mozilla Public License, version 2.0.", "Released under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0"],
    "epl2.terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
                   "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."],
    "epl2.name": ["Licensed under the Eclipse Public License 2.0.", "Eclipse Public License - v 2.0"],
    "epl1.name": ["Licensed under the Eclipse Public License 1.0.", "Eclipse Public License - v 1.0"],
}
# The GNU licences share their sentences: (key, name, version, words before the name, date of the text).
for _key, _name, _version, _dates in (("gpl2", "General", "2", "June 1991"), ("gpl3", "General", "3", "29 June 2007"),
                                      ("lgpl21", "Lesser General", "2.1", "February 1999"), ("lgpl3", "Lesser General", "3", "29 June 2007"),
                                      ("agpl3", "Affero General", "3", "19 November 2007")):
    _full, _of = f"GNU {_name} Public License", [f"version {_version}", f"version {_version}.0"]
    SENTENCES.setdefault(f"{_key}.name", []).extend(
        f"{start} the {_full}{comma} {v}." for start in ("This work is licensed under", "Licensed under", "Released under") for comma in (",", "") for v in _of)
    SENTENCES[f"{_key}.name"].append(f"{_full} Version {_version}, {_dates}")
    _grant = [f"<*> is free software{mark} you can redistribute it and/or modify it under the terms of the {_full} as published by the Free Software Foundation{{}}" for mark in (":",)]
    SENTENCES[f"{_key}.later"] = [g.format(f"{sep} either version {_version} of the License, or (at your option) any later version.") for g in _grant for sep in (",", ";")]
    SENTENCES[f"{_key}.only"] = [g.format(f"{sep} version {_version}{end}") for g in _grant for sep in (",", ";") for end in (".", " of the License.", " only.")]
# Creative Commons licences but those above: every kind in versions 3.0 and 4.0.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
      "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _name in CC.items():
    for _v, _port in (("3.0", "Unported"), ("4.0", "International")):
        SENTENCES.setdefault(f"cc.{_kind.lower()}-{_v[0]}", []).extend(
            f"{start} {what}." for start in ("Licensed under", "This work is licensed under", "Released under")
            for what in (f"CC {_kind} {_v}", f"CC-{_kind}-{_v}", f"a Creative Commons {_name} {_v} {_port} License", f"the Creative Commons {_name} {_v} {_port} License"))
SENTENCES["bsd.endorse"].append("Neither the name of <*> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
SENTENCES["bsd.endorse"].append("Neither the name of <*> nor the names of <*> contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
# Fixed values: (licence, category, sentences in order).
RULES = [
    ("BSD-3-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("Apache-2.0", "permissive", ["apache2.name", "apache2.use", "apache2.copy", "apache2.asis"]),
    ("MIT", "permissive", ["mit.grant", "mit.notice", "asis.software"]),
    ("BSD-2-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl.free", "gpl.useful"]),
    ("MIT", "permissive", ["mit.grant"]),
    ("MIT", "permissive", ["mit.name"]),
    ("Apache-2.0", "permissive", ["apache2.name"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl.free"]),
    ("GPL-3.0-only", "copyleft", ["gpl3.name"]),
    ("CC-BY-NC-4.0", "restricted", ["cc.by-nc-4"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc.by-sa-4"]),
    ("CC-BY-4.0", "permissive", ["cc.by-4"]),
    ("CC0-1.0", "permissive", ["cc.zero"]),
    ("all-rights-reserved", "restricted", ["reserved"]),
    ("BSD-3-Clause", "permissive", ["bsd.name3"]),
    ("BSD-2-Clause", "permissive", ["bsd.name2"]),
    ("ISC", "permissive", ["isc.grant"]),
    ("ISC", "permissive", ["isc.name"]),
    ("0BSD", "permissive", ["0bsd.grant"]),
    ("Unlicense", "permissive", ["unlicense.free"]),
    ("Unlicense", "permissive", ["unlicense.name"]),
    ("MPL-2.0", "copyleft", ["mpl2.form"]),
    ("MPL-2.0", "copyleft", ["mpl2.name"]),
    ("EPL-2.0", "copyleft", ["epl2.terms"]),
    ("EPL-2.0", "copyleft", ["epl2.name"]),
    ("EPL-1.0", "copyleft", ["epl1.name"]),
]
for _key, _id in (("gpl2", "GPL-2.0"), ("gpl3", "GPL-3.0"), ("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0")):
    RULES += [(f"{_id}-or-later", "copyleft", [f"{_key}.later"]), (f"{_id}-only", "copyleft", [f"{_key}.only"])]
    RULES += [(f"{_id}-only", "copyleft", [f"{_key}.name"])] if _key != "gpl3" else []
for _kind in CC:
    for _v in ("3", "4"):
        if (_kind, _v) not in (("BY", "4"), ("BY-SA", "4"), ("BY-NC", "4")):
            RULES.append((f"CC-{_kind}-{_v}.0", "restricted" if "N" in _kind else "copyleft" if "SA" in _kind else "permissive", [f"cc.{_kind.lower()}-{_v}"]))
# Every licence by its SPDX identifier: tags name it directly.
CATEGORY = {name: category for name, category, _ in RULES if name != "all-rights-reserved"}
OLD_IDS = {f"{name}{old}": f"{name}{new}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for old, new in (("", "-only"), ("+", "-or-later"))}
SPDX = {name.lower(): name for name in CATEGORY} | {old.lower(): name for old, name in OLD_IDS.items()}
RULES += [(name, category, [f"spdx.{name}"]) for name, category in CATEGORY.items()]

BREAK = re.compile(rb"(?<=[.!?:;])\s+|\s*[\r\n]+\s*")
MARKS = re.compile(rb"[^a-z0-9\x80-\xff]+")
FOUND = pa.schema([("id", pa.int64()), ("n_sentences", pa.int64()), ("sentence_ids", pa.list_(pa.string())),
                   ("licenses", pa.list_(pa.string())), ("categories", pa.list_(pa.string()))])


def normal(sentence: bytes) -> bytes:
    return MARKS.sub(b" ", sentence.lower()).strip()


FIELD_WORDS = 12
KNOWN = {normal(s.encode()): key for key, forms in SENTENCES.items() for s in forms if "<*>" not in s}
# Sentences with a field: (last words, pattern, identifier), looked up by the last word.
FIELDS: dict[bytes, list] = {}
for _key, _forms in SENTENCES.items():
    for _s in _forms:
        if "<*>" in _s:
            _parts = [normal(p.encode()) for p in _s.split("<*>")]
            _pattern = (rb"(?:[^ ]+ ){1,%d}" % FIELD_WORDS).join(re.escape(p) + b" " if p else b"" for p in _parts[:-1]) + \
                rb"(?:[^ ]+ ){1,%d}" % FIELD_WORDS + re.escape(_parts[-1])
            FIELDS.setdefault(_parts[-1].rsplit(b" ", 1)[-1], []).append((_parts[-1], re.compile(_pattern), _key))
WORDS = max(max(k.count(b" ") + 1 for k in KNOWN), max(e.count(b" ") + 1 for v in FIELDS.values() for e, _, _ in v) + 3 * FIELD_WORDS)
FIRST = {k.split(b" ")[0] for k in KNOWN} | {b"neither"}
TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
TAG_GAP = re.compile(rb"(SPDX-License-Identifier:)[ \t]+", re.I)      # else the tag would end a sentence
TAG_WORDS = re.compile(rb"[A-Za-z0-9.+-]+")


def known(sentence: bytes) -> str | None:
    key = KNOWN.get(sentence)
    if key is None:
        for end, pattern, name in FIELDS.get(sentence.rsplit(b" ", 1)[-1], ()):
            if sentence.endswith(end) and pattern.fullmatch(sentence):
                return name
    return key


def tags(line: bytes) -> list[str]:
    """Identifiers of the licences that an SPDX expression names; what follows WITH is an exception."""
    found, words = [], [w.decode() for w in TAG_WORDS.findall(line)]
    for before, word in zip(["", *words], words):
        if before.upper() != "WITH" and word.lower() in SPDX:
            found.append(f"spdx.{SPDX[word.lower()]}")
    return found


def sentence_ids(text: bytes) -> tuple[int, list[str]]:
    """Number of sentences, identifiers of the known ones in order.  A licence may be
    wrapped over lines, so fragments are also joined with those after them for as long
    as a known sentence could still be that long."""
    parts, tagged = [], {}
    for p in BREAK.split(TAG_GAP.sub(rb"\1", text) if b"dentifier:" in text else text):
        if n := normal(p):
            if b"dentifier:" in p and (tag := TAG.search(p)):
                tagged[len(parts)] = tags(tag[1])
            parts.append(n)
    found, i = [], 0
    while i < len(parts):
        step = 1
        if i in tagged:
            found.extend(tagged[i])
        elif parts[i].split(b" ", 1)[0] in FIRST or b" is free software" in parts[i]:
            whole, j, best = parts[i], i, 0
            while True:
                if name := known(whole):
                    key, best = name, j + 1 - i
                j += 1
                if j >= len(parts) or whole.count(b" ") + 1 >= WORDS:
                    break
                whole += b" " + parts[j]
            if best:
                found.append(key)
                step = best
        i += step
    return len(parts), found


def match_rules(ids: list[str], rules=RULES) -> list[tuple[int, str, str]]:
    """(position, licence, category) of every match, in text order."""
    free, out = [True] * len(ids), []
    for name, category, want in rules:
        while True:
            at, taken = 0, []
            for i, key in enumerate(ids):
                if free[i] and key == want[at]:
                    taken.append(i)
                    at += 1
                    if at == len(want):
                        break
            if at < len(want):
                break
            for i in taken:
                free[i] = False
            out.append((taken[0], name, category))
    return sorted(out)


def _scan(batches):
    for b in batches:
        rows = [], [], [], []
        for t in strings_of(b.column("text")):
            n, ids = sentence_ids(t)
            hits = match_rules(ids) if ids else []
            for out, v in zip(rows, (n, ids, list(dict.fromkeys(h[1] for h in hits)), list(dict.fromkeys(h[2] for h in hits)))):
                out.append(v)
        yield record(FOUND, b.column("id"), *rows)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_sentences, sentence_ids, licenses, categories (in text order;
    licences and categories once each).  Null and empty texts have none; repeated rows
    give equal rows; no row looks at another."""
    small_batches(docs.sparkSession)
    ddl = "id long, n_sentences long, sentence_ids array<string>, licenses array<string>, categories array<string>"
    return doc_rows(docs).mapInArrow(_scan, ddl).select(
        as_doc_id().alias("doc_id"), "n_sentences", "sentence_ids", "licenses", "categories",
        F.size("licenses").cast("long").alias("n_licenses"))
