"""Operator 3 against a plain version: same hashes by the xxhash library, same order, same edits."""

import hashlib
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from clickpath.llm import fingerprints as P
from clickpath.llm import queries
from tests.llm.conftest import EDGE


def plain(text):
    pieces = re.split(P.SEPARATOR, text)
    lanes = [len(pieces) % (1 << 32)] + [0] * (P.WORD_LANES + P.BIT_LONGS)
    for piece in pieces:
        for k in range(P.WORD_LANES + P.BIT_HASHES):
            h = xxhash.xxh64_intdigest(piece.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42))
            if k < P.WORD_LANES:
                lanes[1 + k] = (lanes[1 + k] + (h & 0xFFFFFFFF)) & 0xFFFFFFFF
            else:
                for i in range(16):
                    at = 1 + P.WORD_LANES + 16 * (k - P.WORD_LANES) + i
                    lanes[at] = (lanes[at] + ((h >> i) & 0x0001000100010001)) & 0x3FFF3FFF3FFF3FFF
    return lanes


def as_text(lanes):
    words = 1 + P.WORD_LANES
    return "".join(f"{x:08x}" for x in lanes[:words]) + "".join(f"{x:016x}" for x in lanes[words:])


def likeness(a, b):
    if a == b:
        return 1.0
    signs = []
    for f in (a, b):
        lanes = np.array([x >> s & 0x3FFF for x in f[1 + P.WORD_LANES:] for s in (0, 16, 32, 48)])
        signs.append((2 * lanes - f[0] + (1 << 14)) % (1 << 15) - (1 << 14))
    x, y = signs
    return float(min(1.0, max(0.0, (x @ y) / max(x @ x, y @ y, 1))))


def expected(rows):
    """rows: (id, text); every distinct row in the order of the operator."""
    named = sorted({(i is None, -(i or 0), signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), t or "") for i, t in rows})
    out = {}
    for k, (none, down, _, text) in enumerate(named):
        nxt = named[(k + 1) % len(named)][3]
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        own, changed, after = plain(text), plain(edited), plain(nxt)
        out[None if none else -down, text] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed),
            round(likeness(own, changed), 9), round(likeness(own, after), 9))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def digest(df):
    rows = P.with_likeness(P.with_next_edit(df), {"near_edited": ("fp", "edited_fp"), "near_next": ("fp", "next_fp")})
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("e"), P.as_text(F.col("fp")).alias("f"),
                       P.as_text(F.col("edited_fp")).alias("g"), "near_edited", "near_next")


def test_query_matches_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = expected([(r.doc_id, r.text) for r in docs])
    got = queries.op3_fingerprints(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in docs}
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                round(r.near_next, 9)) == want[r.doc_id, texts[r.doc_id]]
    assert np.mean([r.near_edited for r in got]) > 0.3 and np.mean([r.near_next for r in got]) < 0.15


def test_edge_rows(edge, empty, spark):
    want = expected([(i, t) for i, t, _, _ in EDGE])
    got = digest(edge).collect()
    assert len(got) == len(EDGE)
    assert sorted(map(str, {(r.doc_id, r.n_chars, r.e, r.f, r.g, round(r.near_edited, 9), round(r.near_next, 9)) for r in got})) \
        == sorted(map(str, {(i, *v) for (i, _), v in want.items()}))
    assert digest(empty).count() == 0
    one = digest(spark.createDataFrame([(1, "ab. cd")], "doc_id long, text string")).first()
    assert one.e == hashlib.sha256(b"ab.ab.").hexdigest() and one.near_next == 1.0


def test_order_insertion_and_deletion(spark):
    rows = [("one.\ntwo.\nthree.", "three. one.\ntwo.", "one.\nthree.", "two.")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    for c in "abcd":
        df = P.with_fingerprint(df, c, f"f{c}")
    r = df.select("fa", "fb", "fc", "fd", P.insert(F.col("fc"), F.col("fd")).alias("plus"),
                  P.delete(F.col("fa"), F.col("fd")).alias("minus")).first()
    assert r.fa == r.fb == r.plus and r.minus == r.fc and r.fa != r.fc


def test_lanes_wrap_on_very_long_texts(spark):
    text = "a.\n" * 40_000
    df = P.fingerprint(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert df.first().fingerprint == plain(text)
