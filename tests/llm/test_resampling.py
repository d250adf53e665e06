"""Operator 12 against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from clickpath.llm import importance_resampling as ir
from clickpath.llm import queries
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.001"


def features(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain(docs, target):
    """Rows (id, text) and target texts by the definition."""
    got = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in got for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, n, f in got:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:25 * len(able) // 100])}
    return sorted(((i, n, w, x, rank.get(id(r))) for r in out for i, _, n, w, x in [r]), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_op12_matches_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = queries.op12_importance_resampling(spark, SF)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    assert rows_of(got) == plain(docs, target)


def test_edge_rows(spark, edge, empty):
    target = spark.createDataFrame([("Some words of its own",), (None,), ("",)], "text string")
    got = ir.resample(edge, target, carry=True)
    assert rows_of(got) == plain([(i, t) for i, t, *_ in EDGE], ["Some words of its own"])
    assert {r.row.id for r in got.select("row").collect()} == {"clash"}
    assert rows_of(ir.resample(edge, target.limit(0))) == plain([(i, t) for i, t, *_ in EDGE], [])
    assert ir.resample(empty, target).count() == 0


def test_a_hot_word_long_texts_and_ties(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "É1", "x" * 40, "日本語", "b2b", "<|tag|>"])
    rows = [(k, " ".join(["the"] * 30)) for k in range(200)] + [(7, " ".join(["the"] * 30))] * 5
    rows += [(1000 + k, "\x00".join(word() for _ in range(rng.randint(0, 60)))) for k in range(100)] + [(5000, " ".join(word() for _ in range(60_000)))]
    target = ["the of B2B the", "日本語 of"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))) == plain(rows, target)


@pytest.mark.parametrize("text", ["", "a", "a  b", "-a--b c-", "É!é", "Aé_b9\x7fC", "one two three four"])
def test_the_scan_gives_all_runs(text):
    found = ir.Scanner(3, 10_000).scan(text.encode())
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    assert [f.tolist() for f in found] == [
        [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for i in range(len(words) - n + 1)] for n in (1, 2, 3)]
