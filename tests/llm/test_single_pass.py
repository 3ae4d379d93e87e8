"""Packing, quality rules, licence scans and fingerprints against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from knowntime.llm import fingerprint as fp
from knowntime.llm import licenses, packing, queries, quality

ODD = ["it's I'LL <|endoftext|>x a<|startoftext|>b Été, ÀÉß!! ﬁ Ångström éa ñ. ΣΑΣ İstanbul a\x1cc d\x85e 日本語 ab12,3 x--y (foo) don't'\t\ttab\r\nx",
       "", " ", "\n", "Ünï.'s à'll", None, "word " * 5000, "same line\nsame line\n\nsame line", "a b c a b c a b c", "a b c d", "x" * 10000]
ROWS = [(i, t, ["en", None, "fr"][i % 3]) for i, t in enumerate(ODD)] + [(0, ODD[0], "en"), (3, ODD[6], "en"), (None, "a null id", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


def test_ids_equal_the_tokenizers(sf, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordIds(path, 5000)
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pack_round_trip(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    out = packing.pack(docs.withColumnRenamed("lang", "length"), path, most=64).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and r.length in (1, 2, 4, 8, 16, 32, 64) for r in out)
    assert all(len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in out)
    want = Counter((d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, _ in ROWS)
    got = Counter()
    by_doc: dict = {}
    for r in sorted(out, key=lambda r: r.sequence_id):
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (doc, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        copies = len([p for p in pieces if p.start == 0])
        ids = [x for p in pieces[::copies] for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert len(ids) == n
        got[doc, tuple(ids)] += copies
    assert got == want


def test_binary_pieces():
    assert packing.binary_pieces(2048 * 2 + 5, 2048) == [(0, 2048), (2048, 2048), (4096, 4), (4100, 1)]
    assert packing.binary_pieces(1, 2048) == [(0, 1)]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if three[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_bands(spark, sf, docs):
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    both = docs.selectExpr("doc_id + 1000000 doc_id", "text", "lang").unionByName(given)
    texts = {r.doc_id: r.text for r in both.collect() if r.doc_id != 1000000 and r.doc_id != 1000003}
    out = quality.rate_quality(both, **queries.vocabularies()).collect()
    assert len(out) == both.count()
    for r in out:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.fertility_failed)
    # the bands, from the measured figures in plain Python
    good = {}
    for r in out:
        if not r.base_failed:
            good.setdefault(r.lang or "und", []).append(r)
    for lang, rows in good.items():
        for metric, w, side in quality.BANDS:
            bins = sorted(math.floor(getattr(r, metric) / w) for r in rows)
            q1, q3 = ((bins[math.ceil(len(bins) * q) - 1] + 0.5) * w for q in (0.25, 0.75))
            wide = max(q3 - q1, 5 * w) * quality.REACH
            for r in rows:
                v = getattr(r, metric)
                outside = (v < q1 - wide and side != "high") or (v > q3 + wide and side != "low")
                assert outside == (metric in r.fertility_failed.split(","))


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.rate_quality(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), **queries.vocabularies())
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.35


def test_quality_of_empty_table_and_clashing_column(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.rate_quality(none, **queries.vocabularies()).collect() == []
    clash = spark.createDataFrame([(1, "a b c", "en", "x")], "doc_id long, text string, lang string, n_words string")
    assert quality.rate_quality(clash, **queries.vocabularies()).first().n_words == 3


def test_licences(spark):
    rows = [(1, "Some code.\nReleased under the MIT License.\nMore"), (2, " * Licensed under the Apache License,\n * Version 2.0.\n"),
            (3, "All rights reserved. This work is licensed under the GNU General Public License, version 3."),
            (4, "we say licensed under cc by nc 4.0 here"), (5, "Licensed under CC BY-NC 4.0."), (6, ""), (7, None), (7, None),
            (8, "Released under the MIT License. " * 300)]
    out = {r.doc_id: r for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r.licence, r.version, r.n_known) for d, r in out.items()} == {
        1: ("MIT", None, 1), 2: ("Apache", "2.0", 1), 3: ("GPL", "3", 2), 4: (None, None, 0), 5: ("CC-BY-NC", "4.0", 1), 6: (None, None, 0),
        7: (None, None, 0), 8: ("MIT", None, 300)}
    assert out[3].sentence_ids == ["reserved.all", "gpl.work"]
    assert rows[0][1][out[1].spans[0]:out[1].spans[1]] == "Released under the MIT License"
    grant = [licenses.SENTENCES[x] for x in ("mit.grant", "mit.notice", "mit.as-is")]
    assert licenses.Finder(licenses.SENTENCES, licenses.RULES).licence([x[0] for x in licenses.Finder(licenses.SENTENCES, licenses.RULES).sentences(". ".join(grant))]) == "MIT"


def test_full_notices_heads_tails_and_all_licences():
    finder = licenses.Finder(licenses.SENTENCES, licenses.RULES)

    def named(text):
        return [x[:2] for x in finder.licences(finder.sentences(text))]

    apache = ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
              "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n")
    bsd = ". ".join(licenses.SENTENCES[f"bsd.{x}"] for x in ("redistribute", "source", "binary")) + ".\n"
    third = ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
             "   this software without specific prior written permission.\n")
    lgpl = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\nLicense as published by "
            "the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n")
    assert named(apache) == [("Apache", "2.0")]
    assert named("This project is licensed under the MIT License.") == [("MIT", None)]
    assert named(bsd) == [("BSD-2-Clause", None)] and named(bsd + third) == [("BSD-3-Clause", None)]
    assert named(lgpl) == [("LGPL", "2.1")] and named(lgpl.replace("Lesser", "Affero")) == [("AGPL", "2.1")]
    assert named("This is free and unencumbered software released into the public domain.") == [("Unlicense", None)]
    assert named(licenses.SENTENCES["isc.grant"]) == [("ISC", None)] and named(licenses.SENTENCES["boost.grant"] + ":") == [("BSL", None)]
    assert named("Distributed under the Eclipse Public License, v2.0.") == [("EPL", "2.0")]
    assert named(lgpl + apache) == [("Apache", "2.0"), ("LGPL", "2.1")]
    assert named("we say licensed under the mit license here") == []


def test_names_titles_spdx_and_broken_lines():
    finder = licenses.Finder(licenses.SENTENCES, licenses.RULES)

    def named(text):
        return [x[:2] for x in finder.licences(finder.sentences(text))]

    for text in ("All rights\nreserved.", "All rights  reserved.", "# All rights\n# reserved."):
        assert named(text) == [("proprietary", None)], text
    assert named("This project is MIT licensed.") == [("MIT", None)] and named("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007") == [("GPL", None)]
    assert named("GNU General Public License v3") == [("GPL", "3")] and named("The MIT License\n\nCopyright") == [("MIT", None)]
    assert named("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == [("CC-BY-SA", "4.0")]
    assert named("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint main;") == [("MIT", None), ("Apache", "2.0")]
    assert named("# spdx-license-identifier: (GPL-3.0-or-later AND BSD-3-Clause)") == [("BSD-3-Clause", None), ("GPL", "3.0")]
    assert named("SPDX-License-Identifier: Zlib") == [] and named("we like the mit license a lot") == []


def plain_sentences(text):
    """Identifiers by plain search: every stretch between two marks or line ends, as it is, against every known sentence."""
    import itertools
    import re
    tokens = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z]+|\d+(?:\.\d+)*|[.!?;:]+(?=\s|$)|\n", text, re.A)]
    words, ends = [], {0}
    for t, a, b in tokens:
        if t[0].isalnum():
            words.append((t, a, b))
        else:
            ends.add(len(words))
    ends = sorted(ends | {len(words)})
    found = {}
    for i, j in itertools.combinations(ends, 2):
        stretch = " ".join(w for w, _, _ in words[i:j])
        for name, texts in licenses.SENTENCES.items():
            for known in texts.split("|"):
                rule = " ".join(r"\d+(?:\.\d+)*" if w == "#" else r"\S+(?: \S+){0,7}" if w == "*" else re.escape(w) for w in known.split())
                if re.fullmatch(rule, stretch):
                    found.setdefault((words[i][1], words[j - 1][2]), set()).add(name)
    return found


def test_sentences_by_plain_search(spark, sf):
    """What the scan finds without heads and tails is what plain search finds at the same place, and it misses no stretch."""
    finder = licenses.Finder(licenses.SENTENCES, licenses.RULES)
    r = random.Random(3)
    pool = [t for v in licenses.SENTENCES.values() for t in v.split("|")]
    made = []
    for _ in range(40):
        parts = [r.choice([r.choice(pool).replace("#", "2.0").replace("*", "the holder"), "Some words of ours", "Copyright 2020 us"]) for _ in range(r.randrange(1, 4))]
        made.append(r.choice(["\n", ". ", ".\n# "]).join(p.upper() if r.random() < 0.3 else p for p in parts) + r.choice(["", "."]))
    given = [t.text for t in spark.read.parquet(f"{sf}/documents.parquet").where("char_length(text) < 1500").collect() if "licen" in t.text.lower() or "rights" in t.text]
    for text in [*made, *given[:20]]:
        want = plain_sentences(text)
        got = {(a, b): name for name, _, a, b in finder.sentences(text)}
        for span, name in got.items():
            assert span not in want or name in want[span] or name.startswith("spdx"), (text, span)
        for a, b in want:
            assert any(x <= a and b <= y or (a < y and x < b) for x, y in got), (text, want[a, b])


def test_licence_scan_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary"}
    out = {r.doc_id: r.licence for r in licenses.scan_licences(docs.select("doc_id", "text")).collect()}
    for r in docs.collect():
        held = {v for k, v in lines.items() if k in r.text.split("\n")}
        assert (out[r.doc_id] in held) if held else out[r.doc_id] is None


def test_fingerprints(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "tie"), (4, "another tie")]
    out = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        other = fp.edited(t, after)
        a, b, c = fp.digest(t.encode()), fp.digest(other.encode()), fp.digest(after.encode())
        want[d, len(t), hashlib.sha256(other.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in out) == want


def test_fingerprint_counts_and_bounds(spark):
    data = bytes(range(7)) * 3
    total = sum(max(0, len(data) - j) for _, j in ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)))
    assert fp.triplet_counts(data).sum() == total
    assert fp.likeness(fp.digest(data), fp.digest(data)) == 1.0 and 0 <= fp.likeness(fp.digest(b""), fp.digest(b"x" * 5000)) < 1
    assert fp.edited("abcde", "XYZ") == "abcXY" and fp.edited("abcde", "X") == "abcX"
    assert fp.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fp.fingerprint_documents(spark.createDataFrame([(1, "alone in here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_query_digests(spark, sf):
    out = queries.op2_packing(spark, sf).limit(5).collect()
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in out)
    assert zlib.crc32(b"") == 0
