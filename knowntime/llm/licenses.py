"""Licence scans by sentence rules: known licence sentences become identifiers, and ordered rules name licences by sequences of them."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from knowntime.llm.common import per_text

#: Sentences of public licences and of their short notices, by identifier. "#" stands for a version or year,
#: "*" for one to eight words, "|" parts wordings of one identifier.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
                 "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
                 "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                 "merchantability fitness for a particular purpose and noninfringement",
    "apache.licensed": "licensed under the apache license version #",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "bsd.redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                  "documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific "
                 "prior written permission|the name of * may not be used to endorse or promote products derived from this software without specific "
                 "prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
                 "above copyright notice and this permission notice appear in all copies",
    "unlicense.released": "this is free and unencumbered software released into the public domain",
    "boost.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
                   "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
                   "prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost.licensed": "distributed under the boost software license version #",
    "epl.terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v # which accompanies this "
                 "distribution and is available at|this program and the accompanying materials are made available under the terms of the eclipse public "
                 "license # which is available at",
    "agpl.program": "this * is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
                    "by the free software foundation either version # of the license or at your option any later version",
    "lgpl.program": "this * is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
                    "by the free software foundation either version # of the license or at your option any later version",
    "gpl.work": "this work is licensed under the gnu general public license version #",
    "gpl.program": "this * is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                   "the free software foundation either version # of the license or at your option any later version",
    "gpl.licensed": "licensed under the gnu general public license version #",
    "lgpl.licensed": "licensed under the gnu lesser general public license version #",
    "mpl.subject": "this source code form is subject to the terms of the mozilla public license v #",
    "cc-by-nc.licensed": "licensed under cc by nc #",
    "cc-by-sa.licensed": "licensed under cc by sa #",
    "cc-by.licensed": "licensed under cc by #",
    "cc0.dedicated": "this work is dedicated to the public domain",
    "reserved.all": "all rights reserved",
}
#: Names of licences in short notices ("licensed under the ..."), by licence.
NAMES = {
    "MIT": "mit license|mit", "Apache": "apache license version #|apache license v #|apache license #|apache # license|apache #|apache license",
    "BSD-2-Clause": "bsd 2 clause license|simplified bsd license", "BSD-3-Clause": "bsd 3 clause license|new bsd license|modified bsd license|bsd three clause license",
    "ISC": "isc license", "Unlicense": "unlicense", "BSL": "boost software license version #|boost software license #|boost software license",
    "EPL": "eclipse public license version #|eclipse public license v #|eclipse public license #|eclipse public license",
    "AGPL": "gnu affero general public license version #|gnu affero general public license v #|gnu affero general public license|agplv #|agpl v #|agpl",
    "LGPL": "gnu lesser general public license version #|gnu lesser general public license v #|gnu lesser general public license|lgplv #|lgpl v #|lgpl",
    "GPL": "gnu general public license version #|gnu general public license v #|gnu general public license|gnu gpl version #|gnu gpl v #|gplv #|gpl v #|gpl version #|gpl",
    "MPL": "mozilla public license version #|mozilla public license v #|mozilla public license #|mozilla public license",
    "CC-BY-NC": "cc by nc #", "CC-BY-SA": "cc by sa #", "CC-BY": "cc by #",
}
SENTENCES |= {f"{k.lower()}.short": "|".join(f"{verb} under {terms}{n}" for verb in ("licensed", "released", "distributed", "available", "made available", "published")
                                             for terms in ("", "the ", "the terms of the ") for n in names.split("|")) for k, names in NAMES.items()}
#: A line that is only a licence's name is its title; "mit licensed" follows "this project is".
SENTENCES |= {f"{k.lower()}.named": "|".join([t for n in names.split("|") if " " in n for t in (n, f"the {n}")] + [f"{n} licensed" for n in names.split("|")])
              for k, names in NAMES.items()}
#: Long names of the Creative Commons licences.
SENTENCES |= {"cc-by.long": "licensed under a creative commons attribution # international license|licensed under the creative commons attribution # international license",
              "cc-by-sa.long": "licensed under a creative commons attribution sharealike # international license|licensed under the creative commons attribution sharealike # international license",
              "cc-by-nc.long": "licensed under a creative commons attribution noncommercial # international license|licensed under the creative commons attribution noncommercial # international license"}
#: Identifiers in SPDX lines, by licence.
SPDX = {"MIT": "MIT", "Apache": "Apache", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "Unlicense": "Unlicense", "BSL": "BSL",
        "EPL": "EPL", "AGPL": "AGPL", "LGPL": "LGPL", "GPL": "GPL", "MPL": "MPL", "CC-BY-NC": "CC-BY-NC", "CC-BY-SA": "CC-BY-SA", "CC-BY": "CC-BY", "CC0": "CC0"}
SPDX_LINE = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)", re.I)
SPDX_ID = re.compile(r"[A-Za-z][A-Za-z0-9.+-]*")
SPDX_VERSION = re.compile(r"(.*?)(?:-v?(\d+(?:\.\d+)*))?(?:-only|-or-later|\+)?\Z", re.I)
#: Ordered rules (licence, identifiers that must follow each other in this order); the first that fits names the licence.
RULES = (
    ("MIT", ("mit.grant", "mit.notice", "mit.as-is")), ("MIT", ("mit.grant",)), ("MIT", ("mit.released",)), ("MIT", ("mit.licensed",)),
    ("Apache", ("apache.licensed", "apache.comply")), ("Apache", ("apache.licensed",)),
    ("BSD-3-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.names")), ("BSD-2-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary")),
    ("ISC", ("isc.grant",)), ("Unlicense", ("unlicense.released",)), ("BSL", ("boost.grant",)), ("BSL", ("boost.licensed",)), ("EPL", ("epl.terms",)),
    ("AGPL", ("agpl.program",)), ("LGPL", ("lgpl.program",)), ("LGPL", ("lgpl.licensed",)), ("GPL", ("gpl.program",)), ("GPL", ("gpl.work",)), ("GPL", ("gpl.licensed",)), ("MPL", ("mpl.subject",)),
    ("CC-BY-NC", ("cc-by-nc.licensed",)), ("CC-BY-SA", ("cc-by-sa.licensed",)), ("CC-BY", ("cc-by.licensed",)), ("CC0", ("cc0.dedicated",)),
    *((k, (f"{k.lower()}.long",)) for k in ("CC-BY-NC", "CC-BY-SA", "CC-BY")), *((k, (f"{k.lower()}.short",)) for k in NAMES),
    *((k, (f"spdx.{k.lower()}",)) for k in SPDX), *((k, (f"{k.lower()}.named",)) for k in NAMES), ("proprietary", ("reserved.all",)),
)
#: What may stand between a known sentence and its end.
TAILS = tuple(tuple(t.split()) for t in ("", "the license", "license", "only", "or later", "or any later version", "or at your option any later version",
                                         "or newer", "as published by the free software foundation"))
#: A token is a word or a version; a mark or line end after it may end a sentence.
PIECE = re.compile(r"[A-Za-z]+|\d+(?:\.\d+)*|[.!?;:]+(?=\s|$)|\n", re.A)
VERSION = re.compile(r"\d+(?:\.\d+)*\Z", re.A)


def fits(known: tuple, words: list[str], i: int) -> tuple[int, str] | None:
    """End of the known sentence that starts at word i, and its version."""
    version = ""
    for at, a in enumerate(known):
        if a == "*":
            for k in range(i + 1, min(i + 9, len(words))):
                rest = fits(known[at + 1:], words, k)
                if rest:
                    return rest[0], version or rest[1]
            return None
        if i >= len(words) or not (a == words[i] or (a == "#" and VERSION.match(words[i]))):
            return None
        if a == "#":
            version = version or words[i]
        i += 1
    return i, version


def marks(sentences: dict[str, str]) -> list[str]:
    """Patterns of which every known sentence has one (or an SPDX line): two neighbours, at best with a word of six letters or more, or
    the word of a sentence of one.

    Again and again the one is taken that most of the sentences left have. What may stand between neighbours is no part of a word.
    """
    def of(text: str) -> set[str]:
        words = text.split()
        pairs = [(a, b) for a, b in zip(words, words[1:]) if a.isalpha() and b.isalpha()]
        pairs = [p for p in pairs if max(map(len, p)) > 5] or pairs
        return {f"{a}[^A-Za-z0-9]+{b}" for a, b in pairs} or {w for w in words if w.isalpha()}
    left, out = [of(text) for texts in sentences.values() for text in texts.split("|")], ["spdx"]
    while left:
        counts = Counter(p for found in left for p in found)
        best = max(counts, key=lambda p: (counts[p], len(p), p))
        out.append(best)
        left = [found for found in left if best not in found]
    return out


class Finder:
    """Known sentences by their first word."""

    def __init__(self, sentences: dict[str, str], rules: tuple):
        self.by_start: dict[str, list] = {}
        for name, texts in sentences.items():
            for text in texts.split("|"):
                words = tuple(text.split())
                self.by_start.setdefault(words[0], []).append((words, name))
        for found in self.by_start.values():
            found.sort(key=lambda x: -len(x[0]))       # of equal lengths the one named first
        self.rules = rules
        #: every known sentence has one of these, so other texts are passed over
        self.marks = [(max(m.split("[^A-Za-z0-9]+"), key=len), re.compile(m)) for m in marks(sentences)]

    def may_hold(self, text: str) -> bool:
        """Whether a text can hold a known sentence: first by a mark's longest word, then by the mark."""
        low = text.lower()
        return any(word in low and mark.search(low) for word, mark in self.marks)

    def at(self, words: list[str], breaks: set[int], i: int) -> tuple[str, str, int] | None:
        """(identifier, version, end) of the known sentence at word i, alone or with a tail, up to a break."""
        for known, name in self.by_start.get(words[i], ()):
            found = fits(known, words, i)
            for tail in TAILS if found else ():
                j = found[0] + len(tail)
                if j in breaks and tuple(words[found[0]:j]) == tail:
                    return name, found[1], j
        return None

    def sentences(self, text: str) -> list[tuple[str, str, int, int]]:
        """(identifier, version, start, end) of known sentences, from sentence start to sentence end, in order."""
        if not self.may_hold(text):
            return []
        words, starts, ends, breaks = [], [], [], {0}
        for m in PIECE.finditer(text):
            if m[0][0].isalnum():
                words.append(m[0].lower()), starts.append(m.start()), ends.append(m.end())
            else:
                breaks.add(len(words))
        breaks.add(len(words))
        out, free = [], 0
        for i in sorted(breaks):
            if i < free or i + 1 >= len(words):
                continue
            found = self.at(words, breaks, i)
            if not found and words[i] in ("this", "the", "it", "all"):    # a head: "this project is"
                head = next((k for k in range(i + 1, min(i + 7, len(words) - 1)) if words[k] in ("is", "are")), None)
                found = self.at(words, breaks, head + 1) if head else None
            if found:
                name, version, free = found
                out.append((name, version, starts[i], ends[free - 1]))
        return sorted([*out, *self.spdx(text)], key=lambda x: x[2:])

    @staticmethod
    def spdx(text: str) -> list[tuple[str, str, int, int]]:
        """(identifier, version, start, end) of the known licences in SPDX lines."""
        out = []
        for line in SPDX_LINE.finditer(text):
            for m in SPDX_ID.finditer(line[1]):
                name, version = SPDX_VERSION.match(m[0]).groups()
                known = next((k for k, v in SPDX.items() if v.lower() in (name.lower(), m[0].lower())), None)
                if known:
                    at = line.start(1)
                    out.append((f"spdx.{known.lower()}", version or "", at + m.start(), at + m.end()))
        return out

    def licence(self, names: list[str]) -> str | None:
        """The first rule whose identifiers stand in the text one after another."""
        for licence, needed in self.rules:
            if any(tuple(names[i:i + len(needed)]) == needed for i in range(len(names) - len(needed) + 1)):
                return licence
        return None

    def licences(self, found: list[tuple[str, str, int, int]]) -> list[tuple[str, str | None, int, int]]:
        """(licence, version, start, end) of every rule that fits, in the order of rules; a sentence serves the first rule that takes it."""
        names, free, out = [f[0] for f in found], [True] * len(found), []
        for licence, needed in self.rules:
            n = len(needed)
            for i in range(len(names) - n + 1):
                if all(free[i:i + n]) and tuple(names[i:i + n]) == needed:
                    free[i:i + n] = [False] * n
                    out.append((licence, next((f[1] for f in found[i:i + n] if f[1]), None), found[i][2], found[i + n - 1][3]))
        return out


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Append licence (null if no rule fits), version, n_known, sentence_ids, spans (start and end code points) and licences (every
    licence whose rule fits, with its own version and span) to each document.

    Whole texts are scanned; comment marks, case, punctuation and line breaks inside a sentence make no difference. Null and empty
    texts have no sentences. Each row is judged alone, so repeated rows are judged alike; no shuffle.
    """
    def fn(texts: list[str], held: dict = {}) -> list[tuple]:  # noqa: B006  one table per worker
        finder = held.get("finder") or held.setdefault("finder", Finder(sentences, rules))
        out = []
        for t in texts:
            found = finder.sentences(t)
            names = [f[0] for f in found]
            fit = finder.licences(found)
            licence, version = fit[0][:2] if fit else (None, None)
            out.append((licence, version, len(found), names, [x for f in found for x in f[2:]],
                        [dict(zip(("licence", "version", "start", "end"), x)) for x in fit]))
        return out

    return per_text(docs, "text", "licence string, version string, n_known long, sentence_ids array<string>, spans array<long>, "
                    "licences array<struct<licence: string, version: string, start: long, end: long>>", fn, drop=("text",))
