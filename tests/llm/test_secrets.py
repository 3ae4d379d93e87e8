"""The secret scan against plain search, and its models on held-out strings."""

import hashlib
import math
import random
import re
import string

from knowntime.llm import queries, secrets

RULES = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace(
    "password|passwd|secret|token|api_?key", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in (
        "password", "passwd", "secret", "token", "api_?key")))), 12), ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16)]


def plain(text):
    out = []
    for k, (name, rule, least) in enumerate(RULES):
        out += [(m.start(), k, m.end(), name) for m in rule.finditer(text or "") if len(m[m.lastindex or 0]) >= least]
    return sorted(out)


def joined(spans):
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)


def test_base_rules_by_plain_search_on_a_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_secret_scan(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == [s for s in joined(spans).split(",") if s]


def odd_texts():
    r = random.Random(5)
    bits = ["token=", "Secret: ", "API_KEY = '", "apikey\"='", "passwd", "password  :", "=", "AKIA", "ABCDEFGHIJ0123456789"[:14], "deadbeef01234567", "abcdef", "ghi", " ",
            "\n", "é", "😀", "ſecret=aaaaaaaaaaaaaaaa", "toKen=abcdefghijkl", "x.y", "secret=secret: abcdefghijklmnop", "-", "'", "0123456789abcdef"]
    return ["".join(r.choices(bits, k=r.randrange(0, 25))) for _ in range(400)]


def test_base_rules_on_odd_texts(spark):
    texts = [None, "", "AKIA" * 20, "f" * 300_000, "secret=" * 3000, "token=" + "a1" * 50_000, *odd_texts()]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, found int")
    for r in secrets.scan_secrets(docs).collect():
        assert r.base == joined(plain(texts[r.doc_id])), texts[r.doc_id]


def test_markov_spans_by_the_same_models_in_plain_code(spark):
    r = random.Random(9)
    syllables = ["ta", "ren", "do", "mi", "sel", "kor", "va", "lin", "per", "gu", "na", "tor", "is", "em"]
    word = lambda n: "".join(r.choices(syllables, k=n))
    token = lambda n: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=n))
    rows = [(i, " ".join(word(r.randrange(3, 9)) for _ in range(60)) + (f" é {token(r.randrange(24, 40))} end" if i % 10 == 0 else "")
             + (f" password={token(20)}" if i % 10 == 1 else "")) for i in range(300)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (400, None)]
    labelled = [(token(24), True) for _ in range(300)] + [(word(7) + word(3).upper(), False) for _ in range(300)] + [(None, True), ("x", None)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"),
                               spark.createDataFrame(labelled, "sample string, random boolean")).collect()
    assert len(got) == 303
    planted = {i for i, _ in rows if i is None or i % 10 == 0} - {400}
    hit = [x.doc_id for x in got if x.n_markov]
    assert len([d for d in hit if d in planted]) >= 0.9 * 32 and not [d for d in hit if d not in planted]
    texts = {i: t or "" for i, t in rows}
    for x in got:
        for kind, a, b in (s.split(":") for s in x.spans.split(",") if s):
            if kind == "markov":
                assert re.fullmatch(secrets.TOKEN, texts[x.doc_id][int(a):int(b)])


def test_models_are_smoothed_transition_frequencies(spark):
    got = secrets.fit_ratio(spark.createDataFrame([("abab", True), ("aab", False), ("b é", False)], "sample string, random boolean"))
    a, b, n = secrets.ALPHABET.index("a"), secrets.ALPHABET.index("b"), secrets.LETTERS
    share = lambda c, whole: math.log((c + 0.5) / (whole + 0.5 * n))
    assert math.isclose(got[a * n + b], share(2, 2) - share(1, 2)) and math.isclose(got[b * n + a], share(1, 1) - share(0, 0))
    row = spark.createDataFrame([("abba",)], "v string").select(secrets.log_ratio(secrets.F.col("v"), got)[0].alias("r")).first().r
    assert math.isclose(row, got[a * n + b] + got[b * n + b] + got[b * n + a])


def test_no_rows_and_nothing_random(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan_secrets(empty).collect() == []
    one = secrets.scan_secrets(spark.createDataFrame([(1, "plain words only"), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.base, r.spans) for r in one} == {(1, "", ""), (2, "", "")}
