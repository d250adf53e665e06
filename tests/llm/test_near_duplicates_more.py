"""Operators 4 and 5: repeated rows and ids, parameters that change no result, repeats by brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from clickpath.llm import minhash_dedup, substring_dedup
from clickpath.llm.shingles import Shingler
from tests.llm.test_near_duplicates import brute_force


def filler(seed):
    rng = random.Random(seed)
    return rng, lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_op4_compares_repeated_rows_once(spark, monkeypatch):
    """Two alike texts, each repeated many times under its id, and one of the ids with another text, too."""
    _, fill = filler(1)
    one, other = fill(100), fill(100)
    rows = [(1, " ".join(one))] * 100 + [(2, " ".join([*one[:-1], *fill(1)]))] * 100 + [(2, " ".join(other)), (3, " ".join([*other[:-1], *fill(1)]))]
    sizes, keep = {}, minhash_dedup.keep

    def counted(df, name):
        out = keep(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "keep", counted)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sizes["texts"] == [4] and sizes["classes"] == [4] and sum(sizes["links"]) == 2
    assert len(got) == 202 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (2, 2), (3, 2)}


@pytest.mark.parametrize("rounds, rare", [(0, 8), (1, 2), (2, 3)])
def test_op4_parameters_of_work_change_no_result(spark, monkeypatch, rounds, rare):
    """Groups of documents 0.5 to 0.95 alike with links inside, around passages that all of a group share."""
    monkeypatch.setattr(minhash_dedup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(minhash_dedup, "RARE", rare)
    rng, fill = filler(2)
    rows, passages = [], [fill(60) for _ in range(2)]
    for _ in range(70):
        rows.append([*passages[len(rows) % 2], *fill(rng.randint(2, 16))])
    base = fill(80)
    parts = [fill(6) for _ in range(12)]  # what differs is not rare
    rows += [[*base, *x, *y] for x, y in combinations(parts, 2)]
    for _ in range(25):
        copy = list(rng.choice(rows))
        copy[rng.randrange(len(copy))] = fill(1)[0]
        rows.append(copy)
    rng.shuffle(rows)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, 5)


def test_a_second_row_of_an_id_changes_no_other_span(spark):
    rng, fill = filler(3)
    passages = [fill(55) for _ in range(20)]
    rows = [(2 * k + j, " ".join([*fill(rng.randint(0, 40)), *p, *fill(rng.randint(0, 40))])) for k, p in enumerate(passages) for j in range(2)]
    spans = lambda data: sorted((r.doc_id, r.start_word, r.n_words, r.kept) for r in
                                substring_dedup.removals(spark.createDataFrame(data, "doc_id long, text string")).collect())
    want = spans(rows)
    assert len(want) == 40 and all(n >= 55 for _, _, n, _ in want)
    assert spans(rows + [(0, " ".join(fill(90))), (5, "short"), (7, rows[7][1])]) == want


def plain_repeats(rows):
    """Places (doc, start) of the paragraphs whose clusters occur in several documents, by all pairs of paragraphs."""
    shingler = Shingler(substring_dedup.WORDS)
    found = []
    for doc, text in rows:
        words = shingler.word_hashes([(text or "").encode()])[0]
        shingles = shingler.shingles(words)
        for s, n in zip(*(x.tolist() for x in substring_dedup.paragraphs(words, shingler))):
            found.append((doc, s, n, set(shingles[s:s + n - substring_dedup.WORDS + 1].tolist())))
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            both = len(a[3] & found[j][3])
            if 100 * both >= 80 * (len(a[3]) + len(found[j][3]) - both):
                root[find(i)] = find(j)
    docs = {}
    for k, (doc, *_) in enumerate(found):
        docs.setdefault(find(k), set()).add(doc)
    return sorted((doc, s, n) for k, (doc, s, n, _) in enumerate(found) if len(docs[find(k)]) > 1)


def test_op5_finds_what_all_pairs_find(spark):
    rng, fill = filler(4)
    passages, rows = [fill(n) for n in (24, 51, 70, 140)], []
    for k in range(60):
        words = fill(rng.randint(5, 80))
        for p in rng.sample(passages, rng.randint(0, 2)):
            copy = list(p)
            if rng.random() < 0.3:
                copy[rng.randrange(len(copy))] = fill(1)[0]  # a word changed: some paragraphs are alike, some not
            words += [*copy, *fill(rng.randint(0, 30))]
        rows.append((k, " ".join(words)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, " ".join(fill(14))), (104, rows[3][1][:200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc, r.start, r.n) for r in substring_dedup.repeated_paragraphs(docs).collect())
    want = plain_repeats(rows)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 100

    # spans: every word of a span that goes stands in the kept text of one of its clusters, and whole passages are covered
    texts, spans = {i: (t or "").split() for i, t in rows}, substring_dedup.removals(docs).collect()
    kept = {c: texts[r.doc_id][r.start_word:r.start_word + r.n_words] for r in spans if r.kept for c in r.clusters}
    for r in spans:
        assert 0 <= r.start_word and r.start_word + r.n_words <= len(texts[r.doc_id])
        if not r.kept:
            own = texts[r.doc_id][r.start_word:r.start_word + r.n_words]
            there = set().union(*(kept[c] for c in r.clusters if c in kept))
            assert len([w for w in own if w not in there]) <= max(3, 0.2 * len(own))
    gone = {r.doc_id: r for r in spans if r.doc_id in (100, 101)}
    assert all(not r.kept and (r.start_word, r.n_words) == (0, len(texts[i])) for i, r in gone.items()) and len(gone) == 2


def test_the_sketch_leaves_out_no_alike_pair_and_most_others(spark):
    """Pairs of a band with the likeness are all compared; those with a word changed in the middle (0.6) seldom are."""
    rng, shingler, bander = np.random.default_rng(9), Shingler(substring_dedup.WORDS), substring_dedup.Bander()
    rows, alike, other = [], set(), set()
    for k in range(600):
        words = rng.integers(0, 1 << 63, substring_dedup.PARAGRAPH, dtype=np.uint64)
        edited = words.copy()
        edited[[(23,), (22, 23), (12,)][k % 3],] += np.uint64(1)
        for j, own in enumerate((words, edited)):
            sketch = bander.sketch(shingler.shingles(own), np.array([0]), substring_dedup.PARAGRAPH).view(np.int64)
            rows.append((k, 2 * k + j, int(sketch[0])))
        (other if k % 3 == 2 else alike).add((2 * k, 2 * k + 1))
    got = {(r.a, r.b) for r in substring_dedup.band_pairs(spark.createDataFrame(rows, "band long, whole long, sketch long")).collect()}
    assert alike <= got and len(got & other) < 0.2 * len(other)


def test_bands_are_paired_in_one_pass_whatever_their_size(spark):
    """All bands, small ones paired and of large ones every paragraph, also where a band reaches over many batches."""
    rng, rows = random.Random(5), []
    for band in range(60):
        kinds = rng.choice([1, 2, 3, 40])
        rows += [(band, rng.randrange(kinds) + 100 * (band % 7), 0) for _ in range(rng.choice([1, 2, 5, 8, 9, 10, 30, 90]))]
    rng.shuffle(rows)
    want = set()
    for band in range(60):
        own = [w for b, w, _ in rows if b == band]
        if len(own) <= substring_dedup.SMALL:
            want |= set(combinations(sorted(set(own)), 2))
        elif len(set(own)) > 1:
            want |= {(w, None) for w in own}
    posted = spark.createDataFrame(rows, "band long, whole long, sketch long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 4, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            assert {(r.a, r.b) for r in substring_dedup.band_pairs(posted).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = substring_dedup.band_pairs(posted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_the_words_beside_a_paragraph():
    words = np.arange(1, 41, dtype=np.uint64)
    left, right = substring_dedup.beside(words, np.array([3, 30]), np.array([10, 40]), 77)
    assert left[0, :3].tolist() == [3, 2, 1] and len(set(left[0, 3:].tolist())) == 1 and left[1].tolist() == list(range(30, 3, -1))
    assert right[0].tolist() == list(range(11, 38)) and len(set(right[1].tolist())) == 1
    other, _ = substring_dedup.beside(words, np.array([3]), np.array([10]), 78)
    assert other[0, 3] != left[0, 3]  # beyond its ends a text equals no other


def test_fine_coordinates_keep_links():
    """Sets of the likeness differ in no more bits than the join lets pass; 0.6 alike ones mostly do."""
    rng = np.random.default_rng(5)
    flip = rng.integers(0, 1 << 63, minhash_dedup.FINE, dtype=np.uint64)
    most, differing = minhash_dedup.most_differing(80), []
    assert 204 < most < 300
    for share in (889, 750):  # of 1,000 shingles: likeness 0.8 and 0.6
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:share], rng.integers(0, 1 << 63, 1000 - share, dtype=np.uint64)])
        low = [minhash_dedup.mix(((x[None, :] ^ flip[:, None]) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1)) & np.uint64(1) for x in (a, b)]
        differing.append(int((low[0] != low[1]).sum()))
    assert differing[0] <= most < differing[1]
