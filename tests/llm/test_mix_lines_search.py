"""Operators 2, 6, 8 and 10."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickpath.llm import license_scan, line_dedup, queries, source_mix, sql, topk_search
from clickpath.llm.license_templates import TEMPLATES
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op6_topk_search", "op8_line_dedup"])
def test_queries_match_their_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


# -- mixing -------------------------------------------------------------

def plain_targets(sizes):
    """Shares by weight; what exceeds twice a source is shared again until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: source_mix.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows, docs, block=source_mix.BLOCK_WORDS):
    size_of = Counter()
    for _, text, src in docs:
        size_of[src] += len((text or "").encode().split())
    target, taken = plain_targets(size_of), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == size_of[r.source] and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - float(target[r.source])) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
    for s in size_of:
        assert abs(taken[s] - target[s]) <= 2 * block + 1, (s, taken[s], float(target[s]))


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()
    rows = queries.op10_source_mix(spark, "/root/testdata/sf0.01").collect()
    check_mix(rows, [tuple(r) for r in docs])
    again = queries.op10_source_mix(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_takes_most_documents_whole(spark):
    rows = queries.op10_source_mix(spark, "/root/testdata/sf0.01").collect()
    assert np.mean([r.taken in (0, r.size, 2 * r.size) for r in rows]) > 0.9


def test_mix_with_shards(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD_WORDS", 2000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = source_mix.mix(docs).collect()
    check_mix(rows, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])


def test_mix_of_edge_rows(edge, empty):
    rows = source_mix.mix(edge).collect()
    check_mix(rows, [(i, t, s) for i, t, _, s in EDGE])
    assert source_mix.mix(empty).count() == 0
    assert {r.target for r in source_mix.mix(edge.where("text is null or text = ''")).collect()} == {0.0}
    assert set(source_mix.mix(edge, carry=True).first().row.asDict()) == set(edge.columns)


def test_apportionment_is_by_highest_quotients(spark):
    rng = np.random.default_rng(2)
    items, want = [], {}
    for g in range(12):
        n = int(rng.integers(1, 9))
        votes = rng.integers(1, 400, n).astype(float)
        seats = round(float(votes.sum()) / 7.3)
        ideal = votes / votes.sum() * seats
        items += [(g, k, float(x), 10_000) for k, x in enumerate(ideal)]
        won = [0] * n
        for _ in range(seats):
            k = max(range(n), key=lambda i: (ideal[i] / (2 * won[i] + 1), -won[i], -i))
            won[k] += 1
        want |= {(g, k): w for k, w in enumerate(won)}
    df = spark.createDataFrame(items, "g int, k int, ideal double, most long")
    assert {(r.g, r.k): r.quota for r in source_mix.apportion(df, ["g"], "k").collect()} == want


# -- line dedup ---------------------------------------------------------

def test_lines_against_a_plain_version(edge, empty, spark):
    rows = [(k, "h" if k % 3 else None, "\n".join(["menu", f"own {k}", " menu ", "rare" if k < 2 else f"x{k}", ""])) for k in range(9)]
    rows += [(3, "h", None), (3, "h", ""), (None, "h", "menu\nmenu")] * 2
    df = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("n_lines", F.lit("clash"))
    got = line_dedup.drop_boilerplate(df, "page_id", F.col("host"), F.col("text")).collect()
    pages, with_line = Counter(h for _, h, _ in rows), Counter()
    lines = [(i, h, [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")]) for i, h, t in rows]
    for _, h, own in lines:
        with_line.update((h, x) for x in set(own))
    drop = {k for k, n in with_line.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    want = [(i, h, "\n".join(x for x in own if (h, x) not in drop), len(own), sum((h, x) in drop for x in own)) for i, h, own in lines]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and drop
    none = line_dedup.drop_boilerplate(empty, "doc_id", F.col("source"), F.col("text"))
    assert none.count() == 0
    assert line_dedup.drop_boilerplate(edge, "doc_id", F.col("source"), F.col("text"), carry=True).count() == len(EDGE)


def test_hosts_and_page_text(spark):
    urls = {"http://A.example.com/x": "a.example.com", "https://u:p@b.org:80?q": "b.org", "nonsense": "", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", line_dedup.host_of(F.col("u")).alias("h"))
    assert {r.u: r.h for r in df.collect()} == urls
    html = "<html><style>x</style><p>One <b>two</b></p><script>a<b</script><div>three<br>four</div><!-- <p>no</p> --></html>"
    df = spark.createDataFrame([(html,)], "t string").select(line_dedup.lines_of(line_dedup.page_text(F.col("t"))).alias("l"))
    assert df.first().l == ["One two", "three", "four"]


# -- search -------------------------------------------------------------

def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [0.25]), (100, [0.25]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]),
            (6, [inf, 0.0]), (7, []), (None, [1.0, 1.0]), (8, [-0.0004, 0.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, 4).collect()
    ints = [(i, np.floor(1024 * np.array(e or [], np.float64)).astype(int)) for i, e in rows
            if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: int((a[:min(len(a), len(b))] * b[:min(len(a), len(b))]).sum())
    want = []
    for q, e in {(i, tuple(e)) for i, e in ints if i % 100 == 0}:
        best = sorted((-dot(np.array(e, int), x), i) for i, x in ints if i != q)[:4]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 4).count() == 0


def test_top_k_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL", 37)
    monkeypatch.setattr(topk_search, "GROUP", 3)
    rng = np.random.default_rng(1)
    e = rng.integers(-3, 4, (500, 6)) / 1024.0  # many ties
    df = spark.createDataFrame([(k, v) for k, v in enumerate(e.tolist())], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0, 10).collect()
    x = np.floor(1024 * e).astype(int)
    want = [(q, r + 1, i, -s) for q in range(0, 500, 50) for r, (s, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in range(500) if i != q)[:10])]
    assert sorted(map(tuple, got)) == sorted(want)


# -- licences -----------------------------------------------------------

def bigrams(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return list(zip(words, words[1:]))


def test_licences_against_all_windows(spark):
    """Every window of every text against every template."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy(F.length("text")).limit(150)
    extra = [(9001, "Some text. This work is released under the MIT License. More text follows here."),
             (9002, TEMPLATES["MIT"][-1].upper().replace(",", " ;")), (9003, "words " + TEMPLATES["GPL-3.0"][-1] + " and words"),
             (9004, "licensed to nobody under no license"), (9005, None), (9006, ""), (9007, "MIT")]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + extra
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(name, set(bigrams(t))) for name, texts in TEMPLATES.items() for t in texts]
    for i, text in rows:
        grams, best = bigrams(text or ""), 0.0
        kinds = set(grams)
        for _, own in sets:
            if len(kinds & own) < 0.6 * len(own):
                continue
            for a in range(len(grams)):
                seen = set()
                for g in grams[a:a + 2 * len(own)]:
                    seen.add(g)
                    best = max(best, 2 * len(seen & own) / (len(seen) + len(own)))
        assert got[i].dice == pytest.approx(best if best >= license_scan.LEAST else 0.0, abs=1e-9), (i, text)
    assert [got[i].license for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007)] == ["MIT", "MIT", "GPL-3.0", None, None, None, None]


def test_licence_names_and_long_licences(spark):
    """The words of a grant alone are no licence; notices of a family and passages of long licences are told apart."""
    notice = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public " \
             "License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    texts = [("It was published under the title of the day.", None), ("Now available under the counter.", None),
             ("This work is licensed under the Foo Licence.", None), ("This file is licensed under the terms below.", None),
             ("Published under the GPLv2.", "GPL-2.0"), ("Licensed under MIT", "MIT"),
             (notice.format("program", ";", "", ";", "2"), "GPL-2.0"), (notice.format("program", ":", "", ",", "3"), "GPL-3.0"),
             (notice.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1"), (notice.format("library", ":", "Lesser ", ",", "3"), "LGPL-3.0"),
             (notice.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0"), (notice.format("program", ":", "", ",", "4"), None)]
    texts += [(f"Other words before it. {t} And others.", name) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0",
              "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-ND-4.0") for t in TEMPLATES[name][-2:]]
    found = license_scan.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {texts[r.doc_id][0]: r.license for r in found} == dict(texts)


def test_licences_of_edge_rows(edge, empty):
    got = license_scan.scan(edge).collect()
    assert len(got) == len(EDGE) and [r.license for r in got if r.doc_id == 11] == ["Apache-2.0"] * 2
    assert license_scan.scan(empty).count() == 0


def test_query_finds_the_planted_lines(spark):
    found = {r.doc_id: r.license for r in queries.op2_license_scan(spark, "/root/testdata/sf0.01").collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = defaultdict(lambda: None)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        for line, name in lines.items():
            if line in r.text:
                want[r.doc_id] = name
    assert all(found[i] == n for i, n in want.items()) and len(want) > 20
    assert all(n in (None, "proprietary") for i, n in found.items() if i not in want)
