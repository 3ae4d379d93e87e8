"""URL filter, sharding, mixing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knowntime.llm import mixing, queries, sharding, url_filter
from knowntime.llm.components import connected_components


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def link(target):
    return f'<head><link href="{target}" rel="canonical"></head>'


def test_blocks_spread_over_aliases_and_allow_wins(spark):
    pages = [(1, "http://a.net/x", link("https://b.net/y")), (2, "http://b.net/y", link("http://shop.example.org/es/1")), (3, "http://b.net/y#top", None),
             (4, "http://c.net/", '<META http-equiv=Refresh content="5; url=//d.net/q?a=1&amp;b=2">'), (5, "http://d.net/q?a=1&b=2", link("/r")),
             (6, "http://d.net/r", link("http://x.com/de/1")), (7, "http://d.net/r", link("http://x.com/fr/1")), (8, "http://x.com/de/1", ""),
             (9, "no scheme", link("http://x.com/de/")), (10, None, link("http://x.com/de/")), (11, "HTTP://WWW.Example.ORG/en/12?x", ""),
             (12, "http://example.orgx/es/", None), (13, "https://com/de/", None), (14, "http://e.net", ""), (14, "http://e.net", "")]
    out = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in out.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block",
                                                      9: "allow", 10: "allow", 11: "block", 12: "allow", 13: "block", 14: "allow"}
    assert (out[11].host, out[11].path, out[11].rule) == ("www.example.org", "/en/12", "example.org/en/1")
    assert (out[9].host, out[9].path, out[9].rule) == ("", "", None) and out[14].path == ""


def test_redirect_log_adds_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://a.net/x", "http://hop.net/"), ("http://hop.net/", "http://y.com/de/")], "url string, target string")
    assert url_filter.filter_urls(pages, redirects=log).first().verdict == "block"
    assert url_filter.filter_urls(pages.where("false")).collect() == []


def test_longest_rule_by_plain_search(spark, sf):
    for r in queries.op8_url_filter(spark, sf).collect():
        fits = [(len(h) + len(p), a == "allow", h + p, a) for h, p, a in url_filter.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, default=None)
        assert (r.rule, r.verdict) == ((best[2], best[3]) if best else (None, "allow"))


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        table, size = sharding.curve_table(dims), 1 << dims
        at = {}
        for cell in np.ndindex(*[1 << bits] * dims):
            state = h = 0
            for i in reversed(range(bits)):
                c = table[state * size + sum(((x >> i) & 1) << j for j, x in enumerate(cell))]
                state, h = c // size, h * size + c % size
            at[h] = cell
        assert sorted(at) == list(range(1 << (dims * bits)))
        assert all(sum(abs(a - b) for a, b in zip(at[h], at[h + 1])) == 1 for h in range(len(at) - 1))


def test_index_expression_walks_the_table(spark):
    cells = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    df = spark.createDataFrame(cells, "x int, y int, z int")
    got = {(r.x, r.y, r.z): r.h for r in df.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).collect()}
    path = sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(512)) and all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards_hold_equal_rows_and_narrow_ranges(spark, sf):
    rows = [(i, None if i % 50 == 0 else f"text {i % 7}" * (i % 40), ["en", "de", None][i % 3], None if i % 9 == 0 else f"s{i % 20}") for i in range(999)]
    rows += [(5, "again", "en", "s1")] * 3 + [(None, "x", None, None)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.read.parquet(f"{sf}/documents.parquet")):
        out = sharding.shard_documents(df, 40).collect()
        by = Counter(r.shard for r in out)
        assert len(out) == df.count() and max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(40))
        for s in by:
            assert sorted(r.slot for r in out if r.shard == s) == list(range(by[s]))
        ordered = [r.cell for r in sorted(out, key=lambda r: (r.shard, r.slot))]
        assert ordered == sorted(ordered)
    texts = {r.doc_id: r.text for r in df.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)
    few = spark.createDataFrame(rows[:3], "doc_id long, text string, lang string, source string")
    assert sorted(r.slot for r in sharding.shard_documents(few, 40).collect()) == [0, 0, 0]
    assert sharding.shard_documents(few.where("false"), 40).collect() == []


def test_shards_prune_better_than_id_order(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard_documents(rows, 40).collect()

    def touched(groups):
        return np.mean([len({r.source for r in g}) * len({r.lang for r in g}) for g in groups])

    by_id = sorted(out, key=lambda r: r.doc_id)
    assert touched([[r for r in out if r.shard == s] for s in range(40)]) < 0.7 * touched([by_id[25 * i:25 * i + 25] for i in range(40)])


@pytest.fixture(scope="module")
def mixed(spark):
    sf = "/root/testdata/sf0.01"
    return mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")).collect()


def test_mixing_meets_targets(mixed):
    total = sum(r.n_tokens for r in mixed)
    shares = [sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in mixed) / total for d in ("clean", "rough", "toxic")]
    assert np.abs(np.array(shares) - mixing.TARGETS).sum() < 0.03
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) and abs(r.p_clean + r.p_rough + r.p_toxic - 1) < 1e-9 for r in mixed)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = mixing.fit_domains(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1")
    out = mixing.posteriors(docs.join(held, "doc_id"), model, ("doc_id", "quality", "toxic")).collect()
    right = np.mean([int(np.argmax(r.p)) == (2 if r.toxic else 0 if r.quality else 1) for r in out])
    assert right > 0.9


def test_rates_equal_plain_iteration(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n = rng.integers(0, 90, 200)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    got, share = mixing.fit_rates(df, (0.2, 0.7, 0.1), iterations=6)
    metric = (p * n[:, None]).T @ p / n.sum() + 0.02 * np.eye(3)
    r, best = np.ones(200), (9.0, None)
    for _ in range(7):
        e = (n * r) @ p / n.sum() - [0.2, 0.7, 0.1]
        if np.abs(e).sum() < best[0]:
            best = (np.abs(e).sum(), r)
        r = np.maximum(0, r - 0.8 * (p @ np.linalg.solve(metric, e) + 0.02 * (r - 1)))
    assert np.allclose([x.rate for x in got.orderBy("doc_id").collect()], best[1]) and abs(sum(share) - 1) < 0.2


def test_mixing_without_tokens_or_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels).collect()
    assert len(out) == 4 and all(r.rate >= 0 for r in out)
    assert len(mixing.mix(docs, labels.where("false")).collect()) == 4 and mixing.mix(docs.where("false"), labels).collect() == []


def test_pipeline_stages(spark, sf, tmp_path):
    """Every stage of the pipeline on the smallest tables with cases planted beside them."""
    given = spark.read.parquet(f"{sf}/documents.parquet")
    clean = [r for r in given.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and toxic = 0 and n_chars > 2000 and lang = 'en'").orderBy("doc_id").collect()]
    a, b = clean[0].text, clean[1].text
    passage = " ".join(a.split()[:60])
    near = " ".join(w if i != 40 else "changed" for i, w in enumerate(b.split(" ")))
    fresh = clean[2].text.split()
    random.Random(1).shuffle(fresh)                    # words of a clean text in an order of their own
    half = len(fresh) // 2
    mixed_text = " ".join(fresh[:half]) + " " + passage + " " + " ".join(fresh[half:])
    planted = [(900001, near, "en", "s", 1), (900002, b, "en", "s", 1), (900003, mixed_text, "en", "s", 1),
               (900004, "too short", "en", "s", 1), (900005, None, None, None, None), (900006, "spam spam spam " * 100, "en", "s", 1)]
    docs = given.unionByName(spark.createDataFrame(planted, given.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert not ids["quality_rules"] & {900004, 900005, 900006} and {900001, 900002, 900003} <= ids["quality_rules"]
    assert len(ids["quality_rules"] & {r.doc_id for r in clean}) >= 0.98 * len(clean)
    assert not ids["near_duplicates"] & {900001, 900002} and 900003 in ids["near_duplicates"]
    cut = {r.doc_id: r for r in seen["repeated_passages"]}[900003]
    assert passage[:50] not in cut.text and cut.n_chars == len(cut.text) and cut.text.startswith(" ".join(fresh[:half])[:-10])
    assert {r.doc_id for r in seen["packing"]} == ids["mixing"] and 900003 in ids["mixing"]
    assert sum(r.start == 0 for r in seen["packing"]) == len(seen["mixing"])


def test_sources_that_begin_alike_lie_in_different_levels(spark):
    names = [f"https://www.example.com/feed/{i:03d}" for i in range(64)]
    rows = [(i, "t" * (i % 7), "en" if i % 3 else None, names[i % 64] if i % 97 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cuts = sharding.text_cuts(df, "source", 5)
    assert len(cuts) == 32 and cuts == sorted(cuts) and set(cuts) <= set(names)
    levels = {r.source: r.l for r in df.select("source", sharding.text_level(F.col("source"), cuts).alias("l")).distinct().collect()}
    found = [levels[n] for n in names]
    assert levels[None] == 0 and found == sorted(found) and len(set(found)) == 32 and max(found.count(x) for x in found) <= 3
    out = sharding.shard_documents(df).collect()
    assert len(out) == 2000 and {sum(r.shard == s for r in out) for s in range(40)} == {50}
    per = [len({r.source for r in out if r.shard == s}) for s in range(40)]
    assert sum(per) / 40 < 32                              # a shard holds few of the 64 sources
    flat = df.withColumn("source", F.lit(None).cast("string"))
    assert sharding.text_cuts(flat, "source", 5) == [] and sharding.shard_documents(flat.where("false")).collect() == []


def test_hosts_of_many_labels_take_linear_time(spark):
    import time
    long = "http://" + "a." * 60_000 + "com/de/x"
    pages = spark.createDataFrame([(1, long, None), (2, "http://com/fr/", None)], "page_id long, url string, html string")
    start = time.time()
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()} == {1: ("com/de/", "block"), 2: ("com/fr/", "allow")}
    assert time.time() - start < 60


def test_long_chains_and_hubs_of_redirects(spark):
    n = 3000
    chain = [(f"http://c.net/{i}", f"http://c.net/{i + 1}") for i in range(n)] + [(f"http://h.net/{i}", "http://hub.net/") for i in range(n)]
    chain += [(f"http://c.net/{n}", "http://y.com/de/"), ("http://hub.net/", "http://x.com/fr/"), ("http://h.net/7", "http://y.com/de/2")]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(["http://c.net/0", f"http://c.net/{n // 2}", "http://h.net/5", "http://other.net/"])],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, redirects=spark.createDataFrame(chain, "url string, target string")).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_mixing_tells_the_shares_it_reached(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "vile things there ") * 20) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, 0 if i % 2 else 1) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels).collect()
    (reached,) = {tuple(r.reached) for r in out}
    for i in range(3):
        names = ("p_clean", "p_rough", "p_toxic")
        assert abs(sum(r.rate * r.n_tokens * r[names[i]] for r in out) / sum(r.n_tokens for r in out) - reached[i]) < 1e-9
