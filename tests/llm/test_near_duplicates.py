"""Operators 4 and 5 against brute force; components against union-find."""

import random
from itertools import combinations

import duckdb
import pytest

from clickpath.llm import minhash_dedup, queries, sql, substring_dedup
from clickpath.llm.components import components
from tests.llm.conftest import EDGE


def shingle_set(text, k):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = (text or "").translate(table).encode().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_force(rows, k):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(60)]
    links += [(5, 5)] + [(2000, 2001 + k) for k in range(80)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op4_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({sql.NEAR_DUPLICATES})").fetchall()
    got = [tuple(r) for r in queries.op4_near_duplicates(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got) == sorted(want)


def test_chains_copies_and_shared_passages(spark):
    """Chains of edits (neighbours alike, ends not), a group of copies, documents that mostly share a passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(4):
        words = [word() for _ in range(90)]
        for _ in range(12):
            rows.append(" ".join(words))
            words[rng.randrange(len(words))] = word()
    rows += [rows[0]] * 30
    passage = [word() for _ in range(60)]
    rows += [" ".join([*(word() for _ in range(rng.randint(8, 40))), *passage]) for _ in range(60)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want = brute_force(rows, 5)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_link_in_the_middle_of_lists_without_others(spark):
    """Two alike documents that are neither the first nor the last of any list they share."""
    rng = random.Random(11)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    middle, parts = fill(100), [fill(20) for _ in range(8)]
    rows = [(50, " ".join(middle)), (51, " ".join([*middle[:-1], *fill(1)]))]
    # 0.7 alike to the two, before and after them; what else they hold is frequent, so that they are in the two's lists
    rows += [(k if k % 2 else 100 + k, " ".join([*middle, *x, *y])) for k, (x, y) in enumerate(combinations(parts, 2))]
    rows += [(1000 + k, " ".join([*parts[k % 8], *fill(5)])) for k in range(320)]
    want = brute_force(rows, 5)
    assert want[51][1] == 50 and len({c for _, c in want.values()}) == len(rows) - 1
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_edge_rows(edge, empty):
    got = minhash_dedup.near_duplicates(edge, words=4).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE)
    assert [by[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and all(by[i].component_id == i and by[i].kept for i in (2, 3, 4))
    assert {by[i].component_id for i in (5, 6, -5)} == {-5} and not by[5].kept and by[-5].kept
    assert by[None].component_id is None and by[None].kept
    assert by[8].n_shingles == 1 and by[12].component_id == 12
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    fill = lambda n: [word() for _ in range(n)]
    passage, other = fill(51), fill(60)
    rows = [(k, " ".join([*fill(rng.randint(0, 90)), *passage, *fill(rng.randint(0, 90))])) for k in range(20)]
    edited = list(other)
    edited[3] = word()
    rows += [(100, " ".join([*fill(40), *other, *fill(9)])), (101, " ".join([*fill(5), *edited, *fill(30)]))]
    rows += [(200 + k, " ".join([*fill(100), *passage[:20], *fill(30)])) for k in range(10)]  # too short to count
    rows += [(300 + k, " ".join(fill(150))) for k in range(20)] + [(400, None), (401, ""), (402, "short"), (None, " ".join(passage))]
    rows += [(500, "\n".join([" ".join(passage)] * 1 + [" ".join(fill(10))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.removals(docs).collect()
    assert {r.doc_id for r in got} == {*range(20), 100, 101, 500}
    texts = dict(rows)
    for r in got:
        own = texts[r.doc_id].split()[r.start_word:r.start_word + r.n_words]
        # a paragraph at a passage's edge may hold up to three words beyond it and still be alike
        assert len(set(own) - {*passage, *other, *edited}) <= 6 and len(set(own) & {*passage, *other, *edited}) >= 20
    assert all(r.kept for r in got if r.doc_id == 0) and not any(r.kept for r in got if r.doc_id in (5, 101, 500))


def test_repeated_passages_of_edge_rows(edge, empty):
    assert {r.doc_id for r in substring_dedup.removals(edge).collect()} == set()
    assert substring_dedup.removals(empty).count() == 0


def test_edited_passages_that_share_a_stock_phrase(spark):
    """Pairs of one paragraph each, alike but for their last two words, all with the same phrase of 14 words."""
    rng = random.Random(8)
    fill = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]
    phrase, rows = fill(14), []
    for k in range(300):
        own = fill(9)
        rows += [(2 * k + j, " ".join([*own[:5], *phrase, *own[5:], *fill(1)])) for j in range(2)]
    found = substring_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cluster = {r.doc: r.cluster for r in found}
    pairs = [cluster.get(2 * k) for k in range(300) if cluster.get(2 * k, 0) == cluster.get(2 * k + 1, 1)]
    assert len(pairs) == len(set(pairs)) >= 294


def test_whole_passages_and_nothing_between(spark):
    """All words of repeats of 51 words and more are reported, and not what stands between two of them."""
    rng = random.Random(12)
    fill = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]
    one, two, rows = [fill(51) for _ in range(12)], fill(70), []
    for k, passage in enumerate(one):
        rows += [(10 * k + j, [*fill(rng.randint(0, 60)), *passage, *fill(7), *two, *fill(rng.randint(0, 60))]) for j in range(3)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    spans = {}
    for r in substring_dedup.removals(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.start_word + r.n_words, r.kept))
    for i, words in rows:
        at = [words.index(one[i // 10][0]), words.index(two[0])]
        want = [(at[0], at[0] + 51, i % 10 == 0), (at[1], at[1] + 70, i == 0)]
        # a paragraph at an edge may reach two words beyond, and such paragraphs may be a cluster of their own
        near = lambda span, w: w[0] - 3 <= span[0] and span[1] <= w[1] + 3
        assert all(any(s[2] == w[2] and s[0] <= w[0] and w[1] <= s[1] and near(s, w) for s in spans[i]) for w in want), (i, spans[i], want)
        assert all(any(near(s, w) for w in want) for s in spans[i]), (i, spans[i], want)
