"""Operator 5: repeated passages by MinHash banding of paragraphs.

Copied passages start and end anywhere, so a text is read as overlapping paragraphs of
``PARAGRAPH`` words that begin at anchors chosen by content: a word position is an anchor if
its hash is the least of any ``WINDOW`` positions in a row. A passage of
PARAGRAPH + WINDOW - 1 = 50 words, wherever it stands, holds a whole paragraph, and the
same one in each text. Shorter texts are one paragraph.

Each paragraph's word shingles get ``BANDS`` bands of ``ROWS`` minima. Paragraphs that share a band
with one of another document are candidates; at a likeness of 0.8 two share one with probability
1 - (1 - 0.8^2)^4 = 0.98, and exact repeats always do. Equal word sequences are one class. The
different ones among the candidates are compared by the exact Jaccard coefficient of their shingle
sets, at least 0.8: each set is posted under so many of its rarest shingles that any two with that
likeness meet, and no list is capped.

Linked paragraphs form clusters (connected components). A cluster that occurs in at least
two documents is a repeat: its first occurrence (smallest id, then place) is kept, with paragraphs
of the cluster that overlap it, and the others are removals. Each removal reaches word by word to both sides for
as long as its words equal those beside the kept occurrence, at most ``WINDOW`` words, which is more than an exact
repeat has before its first or after its last paragraph; the kept one reaches as far as any of them. What overlaps or touches, with the
same decision, is reported as one span of words; words that are not seen to repeat are never in between.

Defined cases: null and empty texts have no paragraph; texts under ``LEAST_WORDS`` words neither
match nor are removed; very long texts are read whole, as one row; rows without an id take no part; rows that repeat an id are one
document (what only they share is no repeat), but each has its paragraphs, places and spans by its own text (``row``: hash of id and
text), and rows that repeat both are one; an empty table gives an empty result; other columns are not read. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickpath.llm.common import arrow_batches, forget, keep, text_of, worker_state
from clickpath.llm.components import components
from clickpath.llm.minhash_dedup import possible
from clickpath.llm.pretokens import mix
from clickpath.llm.shingles import Shingler

PARAGRAPH = 24
WINDOW = 27
LEAST_WORDS = 12
WORDS = 5
LIKENESS = 80
BANDS = 4
ROWS = 2
#: Word sequences whose bands a task remembers having given; it changes no result.
KNOWN_PARAGRAPHS = 400_000
#: Different paragraphs of a band that are paired with each other; those of larger bands meet in the prefix join.
SMALL = 8
#: Rows per Arrow batch of band members: three numbers each.
PAIR_ROWS = 1 << 16
#: A paragraph's sketch has the bit of each of its shingles, one of 64. Two sketches differ in no more bits than the sets have shingles
#: that are not in both, and two sets of the likeness have at most so many of these: no pair of the likeness is left out.
SKETCH_DIFFERS = 2 * (PARAGRAPH - WORDS + 1) * (100 - LIKENESS) // (100 + LIKENESS)


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that are the least (of equal ones the last) of some ``window`` places in a row."""
    n = len(hashes)
    window = min(window, n)
    if not n:
        return np.zeros(0, np.int64)
    # ranks are unique and order equal hashes by place, the last one first
    rank = np.empty(n, np.int64)
    rank[n - 1 - np.argsort(hashes[::-1], kind="stable")] = np.arange(n)
    # the least of a window that crosses a block's end: a block's minimum from the right, the next one's from the left
    padded = np.append(rank, np.full(-n % window, n)).reshape(-1, window)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.unique(np.minimum(right[:n - window + 1], left[window - 1:n]))
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    return np.sort(place[least])


def paragraphs(words: np.ndarray, shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (in words) of the paragraphs of a text."""
    n = len(words)
    if n < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= PARAGRAPH:
        return np.zeros(1, np.int64), np.array([n])
    places = mix(words[:n - PARAGRAPH + 1] * np.uint64(0x9E3779B97F4A7C15) + words[1:n - PARAGRAPH + 2])
    start = anchors(places, WINDOW)
    return start, np.full(len(start), PARAGRAPH)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, text) of the rows with an id; row: hash of the id and the text."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    return rows.withColumn("row", F.xxhash64("doc", "text"))


class Bander:
    """Hashes of the word sequences and bands of many paragraphs of one length at once."""

    def __init__(self):
        rng = np.random.default_rng(23)
        self.flip = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        self.factor = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.weight = rng.integers(0, 1 << 63, PARAGRAPH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def sketch(self, shingles: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        return np.bitwise_or.reduce(np.uint64(1) << (shingles[np.arange(n - WORDS + 1)[:, None] + start] >> np.uint64(58)), axis=0)

    def whole(self, words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        return mix((words[np.arange(n)[:, None] + start] * self.weight[:n, None]).sum(axis=0, dtype=np.uint64) + np.uint64(n))

    def bands(self, shingles: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        own = shingles[np.arange(n - WORDS + 1)[:, None] + start]
        key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(start), 1))
        for r in range(ROWS):
            low = np.stack([((own ^ self.flip[k]) * self.factor[k]).min(axis=0) for k in range(r, BANDS * ROWS, ROWS)], axis=1)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        return key


def in_blocks(n: np.ndarray):
    """(length, numbers) of paragraphs of the same length, some at a time."""
    for length in np.unique(n).tolist():
        same = np.flatnonzero(n == length)
        for k in range(0, len(same), 8192):
            yield length, same[k:k + 8192]


def banded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, start, n, whole, bands, sketch) of every paragraph; whole: hash of its word sequence; bands and sketch: null where the
    same task has given those of this word sequence before."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        shingler = worker_state("shingles", "shingler", WORDS, lambda: Shingler(WORDS))
        bander, known = Bander(), set()
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy() for k in (0, 1))
            hashes = shingler.word_hashes(batch.column(2).cast(pa.binary()).to_pylist())
            found = [paragraphs(words, shingler) for words in hashes]
            many = np.array([len(start) for start, _ in found], np.int64)
            if not many.sum():
                continue
            # all texts in a row: no paragraph reaches beyond its own
            size = np.array([len(words) for words in hashes], np.int64)
            owner = np.repeat(np.arange(len(hashes)), many)
            start, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            at = start + (np.cumsum(size) - size)[owner]
            words = np.concatenate(hashes)
            shingles = shingler.shingles(words)
            whole, key, sketch = np.empty(len(at), np.uint64), np.empty((len(at), BANDS), np.uint64), np.empty(len(at), np.uint64)
            for length, some in in_blocks(n):
                whole[some] = bander.whole(words, at[some], length)
            whole = whole.view(np.int64)
            kinds, one = np.unique(whole, return_index=True)
            fresh = np.zeros(len(at), bool)
            fresh[[i for i, w in zip(one.tolist(), kinds.tolist()) if w not in known]] = True
            if len(known) > KNOWN_PARAGRAPHS:
                known.clear()
            known.update(whole[fresh].tolist())
            new = np.flatnonzero(fresh)
            for length, some in in_blocks(n[new]):
                some = new[some]
                key[some], sketch[some] = bander.bands(shingles, at[some], length), bander.sketch(shingles, at[some], length)
            ends = pa.array(np.append(0, np.cumsum(np.where(fresh, BANDS, 0))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array(rows[owner]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(whole),
                 pa.ListArray.from_arrays(ends, pa.array(key[fresh].view(np.int64).ravel()), mask=pa.array(~fresh)),
                 pa.array(sketch.view(np.int64), mask=~fresh)], names=["doc", "row", "start", "n", "whole", "bands", "sketch"])

    return (rows_of(docs, id_col, text_col).select("doc", "row", "text")
            .mapInArrow(run, "doc long, row long, start int, n int, whole long, bands array<long>, sketch long"))


def shingle_sets(variants: DataFrame, docs: DataFrame) -> DataFrame:
    """(whole, times, kind, found) of paragraphs (whole, times, kind, row, start, n); found: their shingle sets, read from that place."""
    places = (variants.groupBy("row")
              .agg(F.collect_list(F.struct("start", "n", "whole", "times", "kind")).alias("at")))

    def sets(batches):
        shingler = worker_state("shingles", "shingler", WORDS, lambda: Shingler(WORDS))
        for batch in batches:
            lists = batch.column(1)
            at, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            hashes = shingler.word_hashes(batch.column(0).cast(pa.binary()).to_pylist())
            size = np.array([len(words) for words in hashes], np.int64)
            start, n = (at.field(k).to_numpy().astype(np.int64) for k in ("start", "n"))
            start += np.repeat(np.cumsum(size) - size, np.diff(ends))
            shingles = shingler.shingles(np.concatenate(hashes))
            for length, some in in_blocks(n):
                own = np.sort(shingles[start[some][:, None] + np.arange(length - WORDS + 1)], axis=1)
                new = np.column_stack([np.ones(len(own), bool), own[:, 1:] != own[:, :-1]])
                bounds = np.append(0, np.cumsum(new.sum(axis=1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(at.field(k).take(pa.array(some)) for k in ("whole", "times", "kind")),
                                                  pa.ListArray.from_arrays(pa.array(bounds), pa.array(own[new].view(np.int64)))],
                                                 names=["whole", "times", "kind", "found"])

    # rows that repeat id and text are one
    return (docs.select("row", "text").join(places, "row").groupBy("row").agg(F.first("text").alias("text"), F.first("at").alias("at"))
            .select("text", "at").mapInArrow(sets, "whole long, times long, kind int, found array<long>"))


def prefixes(sets: DataFrame) -> DataFrame:
    """(s, whole, times, k, own) of the shingles that each set is posted under; k: its size, own: shingles of no other set.

    Two sets with the likeness share LIKENESS percent of either, so one of the rarest shingles that are left without those
    (but for one) is common: a set is posted under these only, and its own ones can't match."""
    rows = sets.select("whole", "times", F.size("found").alias("k"), F.explode("found").alias("s"))
    known = keep(rows.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") > 1), "shingles")
    ranked = (rows.join(known.hint("shuffle_hash"), "s").groupBy("whole")
              .agg(F.min("times").alias("times"), F.min("k").alias("k"), F.sort_array(F.collect_list(F.struct("df", "s"))).alias("_t")))
    need = F.floor((F.col("k") * LIKENESS + 99) / 100).cast("int")
    return ranked.select("whole", "times", "k", (F.col("k") - F.size("_t")).alias("own"),
                         F.explode(F.slice("_t.s", F.lit(1), F.greatest(F.lit(0), F.size("_t") - need + 1))).alias("s"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different paragraphs whose shingle sets have the likeness."""
    side = lambda c: sets.select(F.col("whole").alias(c), F.col("found").alias(f"set_{c}")).hint("shuffle_hash")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * shared >= LIKENESS * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b"))


def joined_lists(posted: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all sets of the likeness among the posted ones, in two tables: in each posting list the others meet the
    most frequent one, and each is linked with its component's smallest; then all pairs of a list that are still in different
    components meet, none is left out."""
    pair = [F.least("whole", "w2").alias("a"), F.greatest("whole", "w2").alias("b")]
    can = possible("k", "own", "k2", "own2", LIKENESS)
    top = posted.groupBy("s").agg(F.max(F.struct("times", "whole", "k", "own")).alias("_top"), F.count("*").alias("_m")).where("_m > 1")
    top = top.select("s", F.col("_top.whole").alias("w2"), F.col("_top.k").alias("k2"), F.col("_top.own").alias("own2"))
    met = keep(posted.join(top.hint("shuffle_hash"), "s").where((F.col("whole") != F.col("w2")) & can).select(*pair).distinct(), "paragraph_pairs")
    links = keep(confirmed(met, sets), "paragraph_links")
    stars = keep(components(links).select(F.col("node").alias("a"), F.col("component").alias("b")), "list_stars")
    labelled = keep(posted.join(stars.hint("shuffle_hash"), F.col("whole") == F.col("a"), "left")
                    .select("s", "whole", "k", "own", F.coalesce("b", "whole").alias("comp")), "labelled")
    still = labelled.groupBy("s").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("s")
    still = keep(labelled.join(still.hint("shuffle_hash"), "s", "left_semi"), "open")
    other = still.select("s", F.col("whole").alias("w2"), F.col("k").alias("k2"), F.col("own").alias("own2"), F.col("comp").alias("c2"))
    rest = keep(still.join(other, "s").where((F.col("whole") < F.col("w2")) & (F.col("comp") != F.col("c2")) & can)
                .select(*pair).distinct().join(met, ["a", "b"], "left_anti"), "open_pairs")
    more = keep(confirmed(rest, sets), "open_links")
    forget(met, links, labelled, still, rest)
    return stars, more


def band_pairs(posted: DataFrame) -> DataFrame:
    """(a, b) of each two different paragraphs of a small band (band, whole, sketch) whose sketches allow the likeness, and (a, null) of
    every paragraph of a larger band of different ones; both may come repeatedly.

    Bands are sorted, so that a task sees one after the other; of a band that reaches beyond a batch it holds a few rows only."""

    def pairs(band, whole, sketch):
        first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        size = np.diff(np.append(first, len(band)))
        some = np.repeat(size > 1, size)
        if not some.any():
            return
        band, whole, sketch = band[some], whole[some], sketch[some]
        size = size[size > 1]
        first = np.cumsum(size) - size
        large = np.repeat((size > SMALL) & (np.minimum.reduceat(whole, first) < np.maximum.reduceat(whole, first)), size)
        many = np.unique(whole[large])
        a, b = [many], [np.zeros(len(many), np.int64)]
        small = np.repeat(size <= SMALL, size)
        band, whole, sketch = band[small], whole[small], sketch[small]
        for d in range(1, SMALL):
            x = np.flatnonzero(band[d:] == band[:-d])
            if not len(x):
                break
            y = x + d
            fits = (whole[x] != whole[y]) & (np.bitwise_count((sketch[x] ^ sketch[y]).view(np.uint64)) <= SKETCH_DIFFERS)
            x, y = whole[x[fits]], whole[y[fits]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) < len(many))], names=["a", "b"])

    def run(batches):
        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [column.to_numpy() for column in batch.columns]
            band, whole, sketch = new if open_ is None else (np.concatenate(both) for both in zip(open_, new))
            cut = int(np.searchsorted(band, band[-1]))
            yield from pairs(band[:cut], whole[:cut], sketch[:cut])
            open_ = band[cut:], whole[cut:], sketch[cut:]
            if len(open_[0]) > SMALL + 1:
                # it is a large one: of those seen, two that differ (if any do) stand for the others
                yield from pairs(*open_)
                stay = np.append(np.arange(SMALL - 1), [open_[1].argmin(), open_[1].argmax()])
                open_ = [column[stay] for column in open_]
        if open_ is not None:
            yield from pairs(*open_)

    return posted.select("band", "whole", "sketch").repartition("band").sortWithinPartitions("band").mapInArrow(run, "a long, b long")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, start, n, cluster, first, kept) of every paragraph whose cluster occurs in several documents; first: it is
    the cluster's first occurrence."""
    texts = rows_of(docs, id_col, text_col)
    found = keep(banded(docs, id_col, text_col), "banded")
    posted = found.where(F.col("bands").isNotNull()).select("whole", "sketch", F.explode("bands").alias("band"))
    arrow_batches(docs.sparkSession, PAIR_ROWS)
    met = keep(band_pairs(posted).distinct(), "band_pairs")
    arrow_batches(docs.sparkSession)
    pairs = met.where(F.col("b").isNotNull())
    # paragraphs to compare with others, and those that several documents have
    variants = (pairs.select(F.col("a").alias("whole")).union(pairs.select("b")).select("whole", F.lit(1).alias("kind"))
                .union(met.where(F.col("b").isNull()).select(F.col("a").alias("whole"), F.lit(2).alias("kind"))))
    repeats = (found.groupBy("whole").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where(F.col("lo") < F.col("hi"))
               .select("whole", F.lit(0).alias("kind")))
    kinds = keep(variants.union(repeats).groupBy("whole").agg(F.max("kind").alias("kind")), "kinds")
    # tables with one row a key are the hashed side of their joins, so that the larger ones need no sorting
    members = keep(found.select("doc", "row", "start", "n", "whole").join(kinds.hint("shuffle_hash"), "whole"), "paragraphs")
    forget(found, kinds)
    place = F.struct("doc", "row", "start", "n")
    # any of its places will do, as all have the same words; columns of numbers are aggregated without sorting
    compared = (members.where("kind > 0").groupBy("whole")
                .agg(F.count("*").alias("times"), F.max("kind").alias("kind"), *(F.first(c).alias(c) for c in ("row", "start", "n"))))
    sets = keep(shingle_sets(compared, texts), "sets")
    near = keep(confirmed(pairs, sets), "band_links")
    often = sets.where("kind = 2")
    posted = keep(prefixes(often), "prefixes")
    stars, more = joined_lists(posted, often)
    linked = keep(components(near.union(stars).union(more)), "linked")
    forget(met, sets, near, posted, stars, more)
    places = keep(members.select("doc", "row", "start", "n", "whole")
                  .join(linked.select(F.col("node").alias("whole"), "component").hint("shuffle_hash"), "whole", "left")
                  .select("doc", "row", "start", "n", F.coalesce("component", "whole").alias("cluster")), "places")
    forget(members, linked)
    clusters = keep(places.groupBy("cluster").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi"), F.min(place).alias("_first"))
                    .where(F.col("_lo") < F.col("_hi")).select("cluster", "_first"), "clusters")
    own = (F.col("row") == F.col("_first.row")) & (F.col("start") < F.col("_first.start") + F.col("_first.n"))
    return places.join(clusters.hint("shuffle_hash"), "cluster").select(
        "doc", "row", "start", "n", "cluster", (place == F.col("_first")).alias("first"), own.alias("kept"))


def beside(words: np.ndarray, start: np.ndarray, end: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """For each paragraph the WINDOW words before it (the nearest first) and after it, 32 bits of each; beyond the text's ends
    stand values that no other row has."""
    wall = mix(np.array([row], np.int64).view(np.uint64) + np.arange(1, 3, dtype=np.uint64))
    padded = np.concatenate([np.full(WINDOW, wall[0]), words, np.full(WINDOW, wall[1])]).astype(np.uint32)
    reach = np.arange(WINDOW)
    return padded[(start + WINDOW - 1)[:, None] - reach], padded[(end + WINDOW)[:, None] + reach]


def extended(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Repeated paragraphs (doc, row, start, n, cluster, first, kept) with the words at their sides for as long as these equal the
    ones beside the cluster's first occurrence; that one reaches as far as any of the others."""
    asked = rows.where(F.col("first") | ~F.col("kept"))
    places = asked.groupBy("row").agg(F.collect_set(F.struct("start", "n", "cluster", "first", "doc")).alias("at"))
    side = pa.binary(4 * WINDOW)

    def sides(batches):
        shingler = worker_state("shingles", "shingler", WORDS, lambda: Shingler(WORDS))
        for batch in batches:
            lists = batch.column(2)
            at, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            start, n = (at.field(k).to_numpy() for k in ("start", "n"))
            rows_ = batch.column(0).to_numpy()
            left, right = np.empty((len(at), WINDOW), np.uint32), np.empty((len(at), WINDOW), np.uint32)
            for k, words in enumerate(shingler.word_hashes(batch.column(1).cast(pa.binary()).to_pylist())):
                own = slice(ends[k], ends[k + 1])
                left[own], right[own] = beside(words, start[own].astype(np.int64), start[own].astype(np.int64) + n[own], int(rows_[k]))
            blob = lambda m: pa.FixedSizeBinaryArray.from_buffers(side, len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [at.field("doc"), pa.array(np.repeat(rows_, np.diff(ends))), at.field("start"), at.field("n"), at.field("cluster"),
                 at.field("first"), blob(left), blob(right)], names=["doc", "row", "start", "n", "cluster", "first", "left", "right"])

    def same(a: pa.Array, b: pa.Array) -> pa.Array:
        words = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(-1, WINDOW)
        differ = np.column_stack([words(a) != words(b), np.ones(len(a), bool)])
        return pa.array(differ.argmax(axis=1).astype(np.int32))

    def reach(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], same(batch.column(5), batch.column(7)), same(batch.column(6), batch.column(8))],
                                             names=["doc", "row", "start", "n", "cluster", "before", "after"])

    texts = docs.select("row", "text").join(places, "row").groupBy("row").agg(F.first("text").alias("text"), F.first("at").alias("at"))
    found = keep(texts.mapInArrow(
        sides, "doc long, row long, start int, n int, cluster long, first boolean, left binary, right binary"), "sides")
    first = keep(found.where("first").select("cluster", F.col("left").alias("left0"), F.col("right").alias("right0")), "first_sides")
    others = keep(found.where(~F.col("first")).join(first.hint("shuffle_hash"), "cluster")
                  .select("doc", "row", "start", "n", "cluster", "left", "right", "left0", "right0")
                  .mapInArrow(reach, "doc long, row long, start int, n int, cluster long, before int, after int"), "reach")
    most = others.groupBy("cluster").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    own = (rows.where("kept").join(keep(most, "most").hint("shuffle_hash"), "cluster", "left")
           .select("doc", "row", "start", "n", "cluster", F.lit(True).alias("kept"),
                   *(F.when(F.col("first"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("before", "after"))))
    both = own.union(others.select("doc", "row", "start", "n", "cluster", F.lit(False), "before", "after"))
    return both.select("doc", "row", (F.col("start") - F.col("before")).alias("start"),
                       (F.col("before") + F.col("n") + F.col("after")).alias("n"), "cluster", "kept")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, start_word, n_words, paragraphs, kept, clusters) of every span of repeated words; paragraphs: those in it."""
    rows = extended(keep(repeated_paragraphs(docs, id_col, text_col), "repeats"), rows_of(docs, id_col, text_col))
    rows = rows.repartition("row", "kept").distinct()
    order = Window.partitionBy("row", "kept").orderBy("start", "n", "cluster")
    before = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    spans = (rows.withColumn("_opens", opens)
             .withColumn("_span", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return (spans.groupBy("row", "kept", "_span")
            .agg(F.min("doc").alias("doc"), F.min("start").alias("start_word"), F.max(F.col("start") + F.col("n")).alias("_end"),
                 F.count("*").alias("paragraphs"), F.sort_array(F.collect_set("cluster")).alias("clusters"))
            .select(F.col("doc").alias(id_col), "row", "start_word", (F.col("_end") - F.col("start_word")).alias("n_words"),
                    "paragraphs", "kept", "clusters"))
