"""Operator 12: importance resampling towards a target distribution of hashed n-grams.

Texts are read as bytes: A-Z in lower case, separators (ASCII other than letters and digits) collapsed to single
spaces. One overlapped regex scan with boundary lookarounds stops at every word and emits the spans of all runs of 1 to ``NGRAMS``
words that begin there; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. Texts are scanned once: their buckets are written to the shared folder, two bytes
a feature, about as much as the texts, and read for what follows. They are counted over all documents and over all target texts, each task
adding up a dense array of its own, so that at most BUCKETS rows a task are shuffled however frequent a word is.

A bucket's gain is floor(1000 * ln of (its smoothed share in the target / its smoothed share in the documents)); a document's
weight is the floored mean of the gains of its features. The BUCKETS gains are broadcast, a fixed size, and added up over
a document's buckets. Gumbel noise, hashed from the seed and the id, is added to the weight, and the documents with the
highest sums are drawn: a sample without replacement by the weights' exponentials. Ranks come from range partitions,
so no task meets all documents.

Defined cases: null and empty texts and texts without words have no features, weight 0 and are never drawn (they have
under ``LEAST_WORDS`` words); very long texts are read whole, span by span; an id that is null is hashed as the empty string, and
of equal sums its row comes last; rows that repeat an id are documents of their own with the same noise; ties go to the smaller
id; an empty table gives an empty result, an empty target a target of no features (all buckets alike); other columns are
not read, unless ``carry`` passes them on.
"""

from __future__ import annotations

import zlib
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from clickpath.llm.common import arrow_batches, forget, global_rank, keep, text_of, worker_state

NGRAMS = 2
BUCKETS = 10_000
LEAST_WORDS = 20
#: Documents drawn, in hundredths of those with LEAST_WORDS words.
SHARE = 25
SEED = 7
#: A-Z in lower case, separators as spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Scanner:
    """Buckets of all n-grams of a text."""

    def __init__(self, ngrams: int, buckets: int):
        self.ngrams, self.buckets = ngrams, buckets
        # the last group is the first word after a space, the one around it the first two and so on; near the end they stay short
        groups = rb"([^ ]++)"
        for _ in range(ngrams - 1):
            groups = rb"(" + groups + rb"(?: [^ ]++)?+)"
        self.pattern = regex.compile(rb" " + groups + rb"(?= |$)")
        self.spans = methodcaller("group", *range(ngrams, 0, -1))

    def words(self, text: bytes) -> bytes:
        """The words in lower case, each after one space."""
        words = text.translate(_PLAIN).split()
        return b" " + b" ".join(words) if words else b""

    def scan(self, text: bytes) -> list[np.ndarray]:
        """The buckets of the runs of 1, 2, ... words."""
        found = map(self.spans, self.pattern.finditer(self.words(text), overlapped=True))
        if self.ngrams > 1:
            found = chain.from_iterable(found)
        crc = np.fromiter(map(zlib.crc32, found), np.uint32).reshape(-1, self.ngrams)
        # the last word begins no run of two, the last two none of three
        return [(crc[:max(0, len(crc) - k), k] % np.uint32(self.buckets)).astype(np.int32) for k in range(self.ngrams)]


def _scanner(ngrams: int, buckets: int) -> Scanner:
    return worker_state("importance", "scanner", (ngrams, buckets), lambda: Scanner(ngrams, buckets))


def features(docs: DataFrame, id_col: str | None, text_col: str, ngrams: int = NGRAMS, buckets: int = BUCKETS, carry: bool = False) -> DataFrame:
    """(id, n_words, buckets) of every row, without ``id_col`` with a null id; buckets: those of all its n-grams as unsigned 16-bit
    numbers (32-bit ones if there are more buckets). With ``carry`` also the whole input row as a struct ``row``."""
    arrow_batches(docs.sparkSession)
    kind = bucket_kind(buckets)

    def run(batches):
        scanner = _scanner(ngrams, buckets)
        for batch in batches:
            words, found = [], []
            for text in batch.column(1).cast(pa.binary()):
                lists = scanner.scan(text.as_py())
                words.append(len(lists[0]))
                found.append(np.concatenate(lists).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(found, pa.binary()), *batch.columns[2:]],
                                             names=["id", "n_words", "buckets", *(["row"] if carry else [])])

    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    own = F.col(id_col) if id_col else F.lit(None).cast("long")
    asked = docs.select(own.alias("id"), text_of(text_col).alias("text"), *([row] if carry else []))
    schema = StructType([asked.schema["id"], StructField("n_words", LongType()), StructField("buckets", BinaryType()), *asked.schema.fields[2:]])
    return asked.mapInArrow(run, schema)


def bucket_kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all the rows fall into each bucket; buckets without one have no row."""
    arrow_batches(found.sparkSession)
    kind = bucket_kind(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0):
                total += np.bincount(np.frombuffer(own.as_py(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts (bucket, n) of the documents and of the target."""
    # both have at most a row a bucket
    counts = lambda df, name: df.select("bucket", F.col("n").alias(name))
    rows = (source.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts(source, "s"), "bucket", "left")
            .join(counts(target, "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    totals = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    smooth = lambda n, other: (F.col(n) + 1).cast("double") * (F.col(other) + buckets)
    gain = F.floor(1000 * F.ln(smooth("t", "all_s") / smooth("s", "all_t"))).cast("long")
    return rows.join(F.broadcast(totals)).select("bucket", gain.alias("gain"))


def weights(found: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``features`` with n_features and weight instead of their buckets."""
    spark = found.sparkSession
    arrow_batches(spark)
    kind = bucket_kind(buckets)
    table = np.zeros(buckets, np.int64)
    for bucket, value in gain.select("bucket", "gain").toArrow().to_pandas().itertuples(index=False):  # BUCKETS rows
        table[bucket] = value
    shared = spark.sparkContext.broadcast(table)
    rest = [c for c in found.columns if c not in ("id", "n_words", "buckets")]

    def run(batches):
        gain = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, 2), np.int64)
            for k, own in enumerate(batch.column(2)):
                at = np.frombuffer(own.as_py(), kind)
                out[k] = len(at), int(gain[at].sum()) // len(at) if len(at) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(out[:, c].copy()) for c in range(2)), *batch.columns[3:]],
                                             names=["id", "n_words", "n_features", "weight", *rest])

    own = found.select("id", "n_words", "buckets", *rest)
    schema = StructType([*own.schema.fields[:2], StructField("n_features", LongType()), StructField("weight", LongType()), *own.schema.fields[3:]])
    return own.mapInArrow(run, schema)


def gumbel(seed: int, key: Column) -> Column:
    """floor(1000 * Gumbel noise) from a hash of the seed and a key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, ngrams: int = NGRAMS, buckets: int = BUCKETS,
             carry: bool = False) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row, and with ``carry`` the whole input row as a struct ``row``; rank:
    the place among the drawn, null for the others."""
    found = keep(features(docs, id_col, text_col, ngrams, buckets, carry), "features")
    counted = [keep(bucket_counts(f, buckets), "buckets") for f in (found, features(target, None, target_col, ngrams, buckets))]
    scored = weights(found, keep(gains(*counted, buckets), "gains"), buckets)
    rows = keep(scored.withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))), "weights")
    forget(found)
    able = rows.where(F.col("n_words") >= least_words)
    drawn = share * able.count() // 100
    ranked = global_rank(able, "_rank", F.desc("score"), F.asc_nulls_last("id"))
    rank = F.when(F.col("_rank") <= drawn, F.col("_rank")).cast("long")
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    others = rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"), *(["row"] if carry else []))
    return ranked.select(*columns, rank.alias("rank"), *(["row"] if carry else [])).union(others)
