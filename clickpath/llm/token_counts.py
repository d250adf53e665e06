"""Operator 1: token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a compact broadcast table (a sorted array of 64-bit pre-token hashes and
one of lengths in tokens) of the corpus's most frequent pre-tokens. Tier two is each
worker's own table of the pre-tokens that tier one lacks, filled by exact encoding.
No pre-token of any text is shuffled: each task only passes on a summary of its most
frequent ones, bounded in size, from which the broadcast table is chosen.

The tables decide only how a length is found, never what it is.

Defined cases: null and empty texts count 0 bytes and 0 tokens; null ids pass through;
repeated rows each get a row; special strings count as their one token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from clickpath.llm.bpe_codec import CACHE_BYTES, CACHE_PIECES, default_vocabulary, encode_singly, load_vocabulary
from clickpath.llm.bpe_model import BpeModel
from clickpath.llm.common import arrow_batches, text_of, worker_state
from clickpath.llm.pretokens import PieceTable, Splitter, blocks

#: Entries of the broadcast table (10 bytes each).
FREQUENT = 1 << 14
#: Pre-tokens in the summary that a task passes on.
TASK_SUMMARY = 1 << 10


class Summary:
    """The most frequent pre-tokens of a stream: counts are kept for four times as many as are
    passed on and the rarest are forgotten, so the memory is bounded."""

    def __init__(self, most: int):
        self.most = most
        self.hashes, self.counts, self.pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, hashes: np.ndarray, counts: np.ndarray, piece) -> None:
        self_at = np.searchsorted(self.hashes, hashes)
        at = np.minimum(self_at, max(0, len(self.hashes) - 1))
        old = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        self.counts[at[old]] += counts[old]
        new = np.flatnonzero(~old)
        if len(new) > 4 * self.most:
            new = np.sort(new[np.argpartition(-counts[new], 4 * self.most)[:4 * self.most]])
        self.hashes = np.insert(self.hashes, self_at[new], hashes[new])
        self.counts = np.insert(self.counts, self_at[new], counts[new])
        self.pieces = np.insert(self.pieces, self_at[new], np.array([piece(k) for k in new.tolist()] + [None], object)[:-1])
        if len(self.hashes) > 4 * self.most:
            self.cut(4 * self.most)

    def cut(self, n: int) -> None:
        if len(self.hashes) > n:
            top = np.sort(np.argpartition(-self.counts, n)[:n])
            self.hashes, self.counts, self.pieces = self.hashes[top], self.counts[top], self.pieces[top]


def frequent_pretokens(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """(piece, count) of the most frequent pre-tokens over all texts, from bounded task summaries."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        splitter, summary = worker_state("token counts", "splitter", 0, Splitter), Summary(TASK_SUMMARY)
        for batch in batches:
            for _, parts in blocks([t for t in batch.column(0).cast(pa.binary()).to_pylist() if t]):
                sizes, data = np.array([len(p) for p in parts], np.int64), b"".join(parts)
                found = splitter.split_block(data, np.cumsum(sizes) - sizes)
                if found:
                    start, end, hashes, _ = found
                    kinds, one, counts = np.unique(hashes, return_index=True, return_counts=True)
                    short = end[one] - start[one] <= CACHE_BYTES
                    kinds, one, counts = kinds[short], one[short], counts[short]
                    summary.add(kinds, counts, lambda k: data[start[one[k]]:end[one[k]]])
        summary.cut(TASK_SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array(summary.pieces.tolist(), pa.binary()), pa.array(summary.counts)],
                                         names=["piece", "count"])

    schema = StructType([StructField("piece", BinaryType()), StructField("count", LongType())])
    return (docs.select(text_col).mapInArrow(run, schema)
            .groupBy("piece").agg(F.sum("count").alias("count"))
            .orderBy(F.desc("count"), "piece").limit(most))


def length_table(spec: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of pre-tokens and their lengths in tokens."""
    size = np.array([len(p) for p in pieces], np.int64)
    end = np.cumsum(size)
    buffer = np.frombuffer(b"".join(pieces), np.uint8)
    hashes = Splitter().hasher.spans(buffer, end - size, end)
    counts = BpeModel(spec).encode_pieces(pieces)[1]
    order = np.argsort(hashes)
    return hashes[order], counts[order].astype(np.uint16)


def span_lengths(model: BpeModel, tier_one, cache: PieceTable, data: bytes, start, end, hashes) -> np.ndarray:
    """Tokens of every pre-token of a block."""
    common, lengths = tier_one
    out = np.zeros(len(hashes), np.int64)
    miss = np.ones(len(hashes), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        miss = common[at] != hashes
        out[~miss] = lengths[at[~miss]]
    rest = np.flatnonzero(miss)
    kinds, one, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
    at = cache.find(kinds)
    known = np.zeros(len(kinds), np.int64)
    known[at >= 0] = cache.values[cache.start[at[at >= 0]]]
    new = np.flatnonzero(at < 0)
    spans = rest[one[new]]
    known[new] = model.encode_pieces([data[a:b] for a, b in zip(start[spans].tolist(), end[spans].tolist())])[1]
    short = new[end[spans] - start[spans] <= CACHE_BYTES]
    cache.add(kinds[short], known[short], np.ones(len(short), np.int64))
    out[rest] = known[back]
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    text = load_vocabulary(vocabulary or default_vocabulary())
    frequent = [bytes(r.piece) for r in frequent_pretokens(docs, text_col).collect()]  # at most FREQUENT rows
    spec = spark.sparkContext.broadcast(text)
    tier_one = spark.sparkContext.broadcast(length_table(text, frequent))

    def run(batches):
        model = worker_state("token counts", "model", spec.value, lambda: BpeModel(spec.value))
        splitter = worker_state("token counts", "splitter", 0, Splitter)
        cache = worker_state("token counts", "lengths", spec.value, lambda: PieceTable(CACHE_PIECES))
        special = [s.encode() for s in model.special]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts = np.zeros(len(texts), np.int64)
            odd = {k for k, t in enumerate(texts) if any(s in t for s in special)}
            for k in odd:
                counts[k] = len(encode_singly(model, texts[k].decode()))
            for numbers, parts in blocks([b"" if k in odd else t for k, t in enumerate(texts)]):
                sizes, data = np.array([len(p) for p in parts], np.int64), b"".join(parts)
                found = splitter.split_block(data, np.cumsum(sizes) - sizes)
                if found is None:
                    own = [len(encode_singly(model, p.decode())) for p in parts]
                else:
                    start, end, hashes, owner = found
                    lengths = span_lengths(model, tier_one.value, cache, data, start, end, hashes)
                    own = np.bincount(owner, weights=lengths, minlength=len(parts)).astype(np.int64)
                np.add.at(counts, numbers, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array(counts)], names=[id_col, "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col), text_of(text_col).alias(text_col)).mapInArrow(
        run, StructType([docs.schema[id_col], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]))
