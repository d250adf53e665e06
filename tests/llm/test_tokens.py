"""Operators 1 and 9 against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickpath.llm import bpe_codec, queries, token_counts
from clickpath.llm.bpe_model import BpeModel
from clickpath.llm.pretokens import PieceTable, Splitter
from tests.llm.conftest import EDGE

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return BpeModel(bpe_codec.load_vocabulary(PATH))


def test_random_texts_encode_as_the_library_does(model, library):
    rng = random.Random(5)
    tokens = [b for b in model.bytes_of if b]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 30)))
             for a in ("ab", "aab ", "erentioth ", "aé \n'sd", "0123 abc!?", "' stlvrem\n　", "' dl\t1") for _ in range(1500)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))).decode("utf8", "replace") for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0x250, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
                      for _ in range(rng.randint(1, 8))) for _ in range(500)]
    texts += ["The and 'tis  of " * 150_000, " " * 5000, "a" * 20000, "ab" * 9999, "a<|endoftext|>b", "<|endoftext|>", "'", "'re"]
    splitter, table = Splitter(), PieceTable(3000)  # small: it starts anew several times
    for k in range(0, len(texts), 700):
        part = texts[k:k + 700]
        ids, sizes = bpe_codec.encode_texts(model, splitter, table, part)
        for own, want in zip(np.split(ids, np.cumsum(sizes)[:-1]), library.encode_batch(part, add_special_tokens=False)):
            assert own.tolist() == want.ids


def test_pair_check_agrees_with_merging(model):
    rng = np.random.default_rng(3)
    sound = np.flatnonzero(model.sound)
    a, b = rng.choice(sound, 4000), rng.choice(sound, 4000)
    want = [model.merge_exactly(model.bytes_of[x] + model.bytes_of[y]) != [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert model.crossing(a, b).tolist() == want


def test_codec_of_edge_rows(edge, library):
    out = bpe_codec.decode(bpe_codec.encode(edge)).collect()
    want = sorted((i is None, i or 0, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _, _ in EDGE)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.text) for r in out) == want


def test_decode_replaces_invalid_bytes(spark, library):
    ids = [library.encode("é", add_special_tokens=False).ids[0], 0, 50256, 127, 188]
    got = bpe_codec.decode(spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>")).orderBy("doc_id").collect()
    assert got[0].text == library.decode(ids, skip_special_tokens=False) and got[1].text == ""


def test_counts_of_edge_rows_and_empty_table(edge, empty, library):
    out = token_counts.count_tokens(edge).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
                  for i, t, _, _ in EDGE)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == want
    assert token_counts.count_tokens(empty).count() == 0
    assert bpe_codec.decode(bpe_codec.encode(empty)).count() == 0


def test_tier_one_holds_frequent_pretokens(docs):
    top = token_counts.frequent_pretokens(docs, most=50).collect()
    import collections

    import regex
    count = collections.Counter(p for r in docs.collect() for p in regex.findall(public_tokenizers.PATTERN, r.text))
    common = {p.encode(): n for p, n in count.most_common(20)}
    got = {bytes(r.piece): r["count"] for r in top}
    assert all(got.get(p) == n for p, n in common.items())


def test_queries_on_a_given_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in rows}
    got = {r.doc_id: r for r in queries.op9_bpe_codec(spark, "/root/testdata/sf0.001").collect()}
    counts = {r.doc_id: r for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(ids) == set(counts)
    for r in rows:
        want = ids[r.doc_id]
        assert got[r.doc_id].n_tokens == counts[r.doc_id].n_tokens == len(want)
        assert counts[r.doc_id].over_limit == (len(want) > 1024) and counts[r.doc_id].n_bytes == len(r.text.encode())
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
