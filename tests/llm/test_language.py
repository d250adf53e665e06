"""Operator 7: code lengths against brute force, held-out accuracy, edge rows."""

import math
import zlib
from collections import Counter

import numpy as np

from clickpath.llm import language_id as L
from clickpath.llm import queries

SF = "/root/testdata/sf0.01"


def test_code_lengths_match_a_plain_tree(docs):
    rows = docs.orderBy("doc_id").collect()
    words = {}
    for r in rows[:100]:
        words.setdefault(r.lang, Counter()).update(L.words_of(r.text))
    parts = [(lang, *L.grams_of(w)) for lang, w in words.items()]
    trees = L.Trees(np.concatenate([np.full(len(g), lang) for lang, g, _ in parts]),
                    np.concatenate([g for _, g, _ in parts]), np.concatenate([n for _, _, n in parts]))
    follow = {lang: {} for lang in words}
    for lang, own in words.items():
        for word, n in own.items():
            data = b" " + word.encode() + b" "
            for i in range(1, len(data)):
                for j in range(max(0, i - L.ORDER), i + 1):
                    follow[lang].setdefault(data[j:i], Counter())[data[i]] += n

    def cost(lang, word):
        data, bits = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(data)):
            for j in range(max(0, i - L.ORDER), i + 1):
                seen = follow[lang].get(data[j:i])
                if seen is None:
                    continue
                total = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    bits += math.log2(total / seen[data[i]])
                    break
                bits += math.log2(total / len(seen))
            else:
                bits += 8.0
        return bits

    new = sorted({w for r in rows[100:120] for w in L.words_of(r.text)})[:300] + ["éßñ", "日本", "x" * 40]
    got = trees.costs([w.encode() for w in new])
    for k, lang in enumerate(trees.langs):
        assert np.allclose(got[:, k], [cost(lang, w) for w in new], atol=1e-9)
    assert got[:, -1].tolist() == [len(w.encode()) + 1 for w in new]


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    known = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(known)
    assert all(rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in known)
    held = [r for r in known if rows[r.doc_id].held_out and r.lang]
    assert np.mean([rows[r.doc_id].lang_pred == r.lang for r in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_training_rows_are_bounded_and_labelled(docs):
    rows = L.training_rows(docs, "text", "lang", 10).collect()
    assert max(Counter(r.lang for r in rows).values()) == 10


def test_copies_take_no_training_places(spark):
    """One text copied very often beside a few others, and alone: each different text trains once."""
    for copied in ("most of these are copies", "a text", "another one", "the last of them"):
        rows = [(copied, "en")] * 20000 + [(f"text number {k}", "en") for k in range(60)] + [(copied, "fr")] * 20000
        got = Counter(tuple(r) for r in L.training_rows(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 40).collect())
        assert max(got.values()) == 1 and Counter(lang for lang, _ in got) == {"en": 40, "fr": 1}


def test_edge_rows(edge, empty):
    trees = L.train(edge)
    rows = L.identify(edge, trees).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == edge.count()
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 10))
    assert got[8].lang_pred == "fr" and got[7].lang_pred == "en" and None in got
    assert L.identify(empty, trees).count() == 0
    assert {r.lang_pred for r in L.identify(edge, L.train(empty)).collect()} == {"und"}


def test_same_result_however_the_rows_are_dealt(docs):
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, L.train(docs)).collect()}
    other = docs.repartition(5)
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in L.identify(other, L.train(other)).collect()}
