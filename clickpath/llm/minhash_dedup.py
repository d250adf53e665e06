"""Operator 4: near-duplicate documents by an inverted join of MinHash coordinates.

Each distinct shingle set (a class) gets a signature of ``COORDINATES`` minima. A class is posted
under its (coordinate, value) tokens; two classes are candidates if at least ``MATCHES``
coordinates agree, and candidates are confirmed on their full shingle sets.

Prefix: tokens are ordered from rare to frequent. Two classes that agree in MATCHES of
COORDINATES tokens share one among the COORDINATES - MATCHES + 1 rarest of each, so only
those are posted. Tokens of one class only fill the front of that prefix and cannot
match, so a class with enough of them is never posted at all, and a passage that many
documents share is only posted by documents that consist mostly of shared text.

Skip: what is wanted are the groups, so no list is expanded into all its pairs. In each of ``STAR_ROUNDS``
rounds a posting list whose members are all in one component is skipped for good; in any other, each
member meets one or two members of other components. What is then still open is merged exactly:

* Shingles that at most ``RARE`` posted classes have are lists of their own. Two sets of the likeness that share
  one of these also share one among their rarest shingles (a prefix of the set), so members of different
  components meet in lists of at most RARE members.
* Two sets that share none of them have at most what is left in common. A class with more than a fifth of rare shingles
  is out of the lists of tokens, and two classes only meet there if what is left is enough for the likeness, this token is
  the first that both have, MATCHES coordinates collide, and so do enough of ``FINE`` further ones, of which only the classes
  that are still in open lists get one bit each; all as the condition of the join.

No list is capped and both bounds on shingles are exact. ``RARE`` and STAR_ROUNDS change the work, not the result.
At a likeness of 0.8, the chance that fewer than MATCHES = 32 of 64 coordinates agree is
below 1e-6 a pair, as is that of too many differing bits (5 standard deviations).

Defined cases: null and empty texts and texts without words have an empty set and link
with nothing; very long texts are read whole, as one row; texts with equal sets are one class from the start and are
compared once; rows that repeat an id are each judged by their own text; rows without an id take no part
(component null, kept); an empty table gives an empty result; other columns are not read. Ids are integers or text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from clickpath.llm.common import arrow_batches, keep, text_of, worker_state
from clickpath.llm.components import components
from clickpath.llm.pretokens import mix
from clickpath.llm.shingles import Shingler, overlap

COORDINATES = 64
MATCHES = 32
PREFIX = COORDINATES - MATCHES + 1
STAR_ROUNDS = 2
#: Most classes that a shingle is rare with.
RARE = 8
#: Coordinates, of one bit each, that classes in lists which stay open are compared by.
FINE = 2048
#: Least likeness of near-duplicates, in hundredths, and words a shingle.
LIKENESS = 80
WORDS = 5


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h); h: hash of the text."""
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("h"))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, h, n, fp1, fp2, sig) of every row: hash of the text, set size, two sums that identify the set, minima."""
    arrow_batches(docs.sparkSession)
    rng = np.random.default_rng(13)
    flip = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
    factor = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def minima(own: np.ndarray) -> np.ndarray:
        low = np.full(COORDINATES, np.iinfo(np.uint64).max)
        for at in range(0, len(own), 2048):
            low = np.minimum(low, ((own[None, at:at + 2048] ^ flip[:, None]) * factor[:, None]).min(axis=1))
        return low

    def run(batches):
        shingler = worker_state("shingles", "shingler", words, lambda: Shingler(words))
        for batch in batches:
            sets = shingler.sets(batch.column(1).cast(pa.binary()).to_pylist())
            n = np.array([len(s) for s in sets], np.int64)
            sums = [[s.sum(dtype=np.uint64), (s * (s >> np.uint64(32) | np.uint64(1))).sum(dtype=np.uint64)] for s in sets]
            sums = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            full = [minima(s) for s in sets if len(s)]
            flat = np.concatenate(full).view(np.int64) if full else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum(np.where(n > 0, COORDINATES, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "h", "n", "fp1", "fp2", "sig"])

    schema = StructType([StructField("id", docs.schema[id_col].dataType), *(StructField(c, LongType()) for c in ("h", "n", "fp1", "fp2")),
                         StructField("sig", ArrayType(LongType()))])
    return named(docs, id_col, text_col).mapInArrow(run, schema)


def postings(classes: DataFrame) -> DataFrame:
    """(c, n, tokens, posted) of the classes that share MATCHES tokens with others; tokens: those that some other class also
    has, from rare to frequent; posted: how many of them are the prefix."""
    tokens = (classes.select("c", "n", F.posexplode("sig").alias("at", "low"))
              .select("c", "n", F.xxhash64("at", "low").alias("token")))
    # written, so that the join below shuffles both sides and a hot token's rows can be split
    shared = keep(tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1), "shared")
    ranked = (tokens.join(shared, "token").groupBy("c")
              .agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("_t")))
    return (ranked.where(F.size("_t") >= MATCHES)
            .select("c", "n", F.col("_t.token").alias("tokens"), (F.size("_t") - F.lit(COORDINATES - PREFIX)).alias("posted")))


def texts_of(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(c, text): one text of each class (c, id, h), however many rows repeat it."""
    return (named(docs, id_col, text_col).join(classes, ["id", "h"])
            .groupBy("id", "h").agg(F.first("c").alias("c"), F.first("text").alias("text")).select("c", "text"))


def agreeing(pairs: DataFrame, active: DataFrame, likeness: int) -> DataFrame:
    """Pairs (a, b) whose set sizes allow the likeness and in which MATCHES coordinates agree."""
    side = lambda c: active.select(F.col("c").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * F.least("n_a", "n_b") >= likeness * F.greatest("n_a", "n_b"))
            .where(F.size(F.array_intersect("t_a", "t_b")) >= MATCHES).select("a", "b"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, likeness: int) -> DataFrame:
    """Pairs whose full shingle sets have the likeness."""

    def run(batches):
        shingler = worker_state("shingles", "shingler", words, lambda: Shingler(words))
        last, kept = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            same = []
            for k in range(len(a)):
                if last != a[k]:
                    last, kept = a[k], shingler.sets([left[k].as_py()])[0]
                other = shingler.sets([right[k].as_py()])[0]
                shared = overlap(kept, other)
                same.append(100 * shared >= likeness * (len(kept) + len(other) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())],
                                             names=["a", "b", "same"])

    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("same", BooleanType())])
    side = lambda c: texts.select(F.col("c").alias(c), F.col("text").alias(f"text_{c}"))
    # the side that many pairs share comes last: its text is not carried through a shuffle for each pair
    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(run, schema).where("same").select("a", "b"))


def rare_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(s, df, members: array of (c, n)) of the shingles that at most RARE classes have; n: set size."""

    def run(batches):
        shingler = worker_state("shingles", "shingler", words, lambda: Shingler(words))
        for batch in batches:
            sets = shingler.sets(batch.column(1).cast(pa.binary()).to_pylist())
            ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             names=["c", "shingles"])

    schema = StructType([StructField("c", LongType()), StructField("shingles", ArrayType(LongType()))])
    rows = texts.select("c", "text").mapInArrow(run, schema).select("c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    # each task passes on at most RARE + 1 rows a shingle, so that a hot one is no group
    first = F.row_number().over(Window.partitionBy("s").orderBy("c"))
    return (rows.withColumn("_first", first).where(F.col("_first") <= RARE + 1)
            .groupBy("s").agg(F.count("*").alias("df"), F.collect_list(F.struct("c", "n")).alias("members"))
            .where(F.col("df") <= RARE))


def rare_of(lists: DataFrame, likeness: int) -> DataFrame:
    """(c, own, rare, prefix) of the classes with rare shingles: how many only this class has, how many are rare, and those
    shared ones among the rarest of its set of which any two sets of the likeness share the first one."""
    rows = lists.select("s", "df", F.explode("members").alias("m")).select("s", "df", "m.c", "m.n")
    shared = F.when(F.col("df") > 1, F.struct("df", "s"))
    per = rows.groupBy("c").agg(F.min("n").alias("n"), F.count_if(F.col("df") == 1).alias("own"), F.count("*").alias("rare"),
                                F.sort_array(F.collect_list(shared)).alias("_s"))
    ahead = F.col("n") - F.ceil(F.col("n") * likeness / 100) + 1 - F.col("own")
    return per.select("c", "own", "rare", F.slice("_s.s", F.lit(1), F.greatest(F.lit(0), ahead).cast("int")).alias("prefix"))


def possible(n: str, own: str, n2: str, own2: str, likeness: int):
    """Whether two sets can have the likeness: they share at most what neither has for its own."""
    shared = F.least(F.col(n) - F.col(own), F.col(n2) - F.col(own2))
    return 100 * shared >= likeness * (F.col(n) + F.col(n2) - shared)


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def open_lists(posted: DataFrame, comp: DataFrame, round_no: int) -> DataFrame:
    """(token, c, comp, lo, hi, first, last): the members of lists with several components; lo and hi: the smallest and
    largest component, first and last: a member of each, another one each round."""
    labelled = posted.join(comp, "c")
    order = F.xxhash64("c", "token", F.lit(round_no))
    pivot = labelled.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.min(F.struct("comp", order.alias("o"), "c")).alias("first"),
        F.max(F.struct("comp", order.alias("o"), "c")).alias("last")).where(F.col("lo") < F.col("hi"))
    return labelled.join(pivot, "token").select("token", "c", "comp", "lo", "hi", F.col("first.c").alias("first"), F.col("last.c").alias("last"))


def star_pairs(met: DataFrame, both: bool) -> DataFrame:
    """In each open list: every member with a member of the first component, and with ``both`` also with one of the
    last, if it is in another one."""
    out = met.where(F.col("comp") != F.col("lo")).select(*_pair(F.col("c"), F.col("first")))
    if both:
        out = out.union(met.where(F.col("comp") != F.col("hi")).select(*_pair(F.col("c"), F.col("last"))))
    return out.distinct()


def rare_pairs(rare: DataFrame, sizes: DataFrame, comp: DataFrame, likeness: int) -> DataFrame:
    """Pairs of members of different components in the lists of rare shingles."""
    member = F.struct("c", "n", "own", "comp")
    lists = (rare.select("c", F.explode("prefix").alias("s")).join(sizes.select("c", "n", "own"), "c").join(comp, "c")
             .groupBy("s").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.collect_list(member).alias("m"))
             .where(F.col("_lo") < F.col("_hi")))  # at most RARE members
    x = lists.select("m", F.explode("m").alias("x")).select("x.*", "m")
    y = (x.select("c", "n", "own", "comp", F.explode(F.filter("m", lambda y: (y["c"] > F.col("c")) & (y["comp"] != F.col("comp")))).alias("y"))
         .select("c", "n", "own", F.col("y.c").alias("c2"), F.col("y.n").alias("n2"), F.col("y.own").alias("own2")))
    return y.where(possible("n", "own", "n2", "own2", likeness)).select(*_pair(F.col("c"), F.col("c2"))).distinct()


def fine_bits(texts: DataFrame, words: int) -> DataFrame:
    """(c, bits): one bit of each of FINE further minima, 64 a number."""
    rng = np.random.default_rng(17)
    flip = rng.integers(0, 1 << 63, FINE, dtype=np.uint64)
    factor = rng.integers(0, 1 << 63, FINE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def bits(own: np.ndarray) -> np.ndarray:
        low = np.full(FINE, np.iinfo(np.uint64).max)
        for at in range(0, len(own), 128):
            low = np.minimum(low, ((own[None, at:at + 128] ^ flip[:, None]) * factor[:, None]).min(axis=1))
        return np.packbits((mix(low) & np.uint64(1)).astype(bool)).view(np.int64)

    def run(batches):
        shingler = worker_state("shingles", "shingler", words, lambda: Shingler(words))
        for batch in batches:
            sets = shingler.sets(batch.column(1).cast(pa.binary()).to_pylist())
            flat = np.concatenate([bits(s) for s in sets]) if sets else np.zeros(0, np.int64)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * (FINE // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["c", "bits"])

    schema = StructType([StructField("c", LongType()), StructField("bits", ArrayType(LongType()))])
    return texts.select("c", "text").mapInArrow(run, schema)


def most_differing(likeness: int) -> int:
    """Differing bits of two sets of the likeness, but for 5 standard deviations."""
    p = (100 - likeness) / 200
    return math.ceil(FINE * p + 5 * math.sqrt(FINE * p * (1 - p)))


def list_pairs(posted: DataFrame, active: DataFrame, sizes: DataFrame, comp: DataFrame, texts: DataFrame, words: int, likeness: int) -> DataFrame:
    """Pairs of members of different components of the open lists that share no rare shingle and collide in MATCHES
    coordinates and in the fine ones; each pair comes from the first token that both have."""
    able = sizes.where(100 * (F.col("n") - F.col("rare")) >= likeness * F.col("n")).select("c", "n", "rare")
    labelled = keep(posted.join(able, "c").join(comp, "c"), "labelled")
    parts = labelled.groupBy("token", "comp").agg(F.count("*").alias("m"))
    # members outside the list's largest component meet all others
    main = keep(parts.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("m", "comp"))["comp"].alias("main"))
                .where(F.col("parts") > 1).select("token", "main"), "main")
    members = keep(labelled.join(main, "token"), "members")
    known = keep(fine_bits(texts.join(members.select("c").distinct(), "c"), words), "bits").join(active.select("c", "tokens"), "c")
    members = keep(members.join(known, "c"), "members")
    x = members.where(F.col("comp") != F.col("main")).select("token", "c", "comp", "n", "rare", "tokens", "bits")
    y = members.select("token", "main", F.col("c").alias("c2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"),
                       F.col("rare").alias("rare2"), F.col("tokens").alias("tokens2"), F.col("bits").alias("bits2"))
    differing = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits2", F.lit(k)))) for k in range(FINE // 64)), F.lit(0))
    common = F.array_intersect("tokens", "tokens2")
    return (x.join(y, (x["token"] == y["token"]) & (F.col("comp") != F.col("comp2"))
                   & ((F.col("comp2") == F.col("main")) | (F.col("c") < F.col("c2")))
                   & possible("n", "rare", "n2", "rare2", likeness) & (differing <= most_differing(likeness))
                   & (F.get(common, F.lit(0)) == x["token"]) & (F.size(common) >= MATCHES))
            .select(*_pair(F.col("c"), F.col("c2"))))


def merged(links: DataFrame, comp: DataFrame) -> DataFrame:
    """(c, comp) after the links join components."""
    joined = (links.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b")
              .where(F.col("ca") != F.col("cb")).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    found = components(joined)
    return keep(comp.join(found, F.col("comp") == F.col("node"), "left").select("c", F.coalesce("component", "comp").alias("comp")), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    likeness: int = LIKENESS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    rows = keep(signatures(docs, id_col, text_col, words), "signatures")
    classes = keep(rows.where(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("fp1", "fp2", "n")
                   .agg(F.min(F.struct("id", "h")).alias("at"), F.first("sig").alias("sig"))
                   .select(F.xxhash64("fp1", "fp2", "n").alias("c"), "fp1", "fp2", "n", "at.id", "at.h", "sig"), "classes")
    active = keep(postings(classes), "active")
    texts = keep(texts_of(classes.select("c", "id", "h").join(active.select("c"), "c"), docs, id_col, text_col), "texts")
    rare = keep(rare_of(rare_shingles(texts, words), likeness), "rare")
    sizes = keep(active.select("c", "n").join(rare.select("c", "own", "rare"), "c", "left")
                 .select("c", "n", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("rare", F.lit(0)).alias("rare")), "sizes")
    lonely = sizes.where(100 * (F.col("n") - F.col("own")) < likeness * F.col("n")).select("c")
    posted = (active.select("c", F.explode(F.slice("tokens", F.lit(1), F.col("posted"))).alias("token")).join(lonely, "c", "left_anti"))
    comp = active.select("c", F.col("c").alias("comp"))
    seen = None
    for round_no in range(STAR_ROUNDS + 1):
        if round_no < STAR_ROUNDS:
            met = keep(open_lists(posted, comp, round_no), "open")
            posted = met.select("c", "token")
            pairs = star_pairs(met, round_no > 0)
        else:
            pairs = rare_pairs(rare, sizes, comp, likeness)
        pairs = keep(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        found = agreeing(pairs, active, likeness)
        if round_no == STAR_ROUNDS:  # pairs of the lists agree already
            listed = list_pairs(posted, active, sizes, comp, texts, words, likeness)
            found = found.union(listed if seen is None else listed.join(seen, ["a", "b"], "left_anti")).distinct()
        links = keep(confirmed(found, texts, words, likeness), "links")
        seen = pairs if seen is None else seen.union(pairs)
        if not links.isEmpty():
            comp = merged(links, comp)
    moved = comp.where(F.col("c") != F.col("comp"))
    groups = keep(moved.union(moved.select("comp", "comp").distinct()), "groups")
    least = groups.join(classes.select("c", "id"), "c").groupBy("comp").agg(F.min("id").alias("least"))
    label = (classes.select("fp1", "fp2", "n", "c", "id").join(groups.join(least, "comp").select("c", "least"), "c", "left")
             .select("fp1", "fp2", "n", F.coalesce("least", "id").alias("least")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return (rows.select("id", "n", "fp1", "fp2").join(label, ["fp1", "fp2", "n"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
